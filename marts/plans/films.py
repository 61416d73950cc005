"""The two film marts, each as a relational and as a document target."""

from __future__ import annotations

from dataclasses import replace

from ..operators.cursor import CursorColumns
from ..operators.transforms import film_dim, normalize_title
from .spec import JobSpec, TargetSpec

FILM_DIM = TargetSpec(
    name="film_dim",
    key=("film_id",),
    schema="film_id STRING NOT NULL, title STRING NOT NULL, rating DECIMAL(3,1), "
    "updated_at TIMESTAMP",
    required=("film_id", "title"),
    load_time="updated_at",
)
FILM_RATING_AGG = TargetSpec(
    name="film_rating_agg",
    key=("film_id",),
    schema="film_id STRING NOT NULL, avg_rating DECIMAL(3,2), rating_count INT, "
    "updated_at TIMESTAMP",
    load_time="updated_at",
)
FILM_DIM_DOCUMENTS = TargetSpec(
    name="film_dim_documents",
    key=("film_id",),
    schema="film_id STRING, title STRING, rating FLOAT",
    mode="merge",
)
FILM_RATING_AGG_DOCUMENTS = TargetSpec(
    name="film_rating_agg_documents",
    key=("film_id",),
    schema="film_id STRING, avg_rating FLOAT, rating_count INT",
    mode="merge",
)

FILMS_QUERY = "SELECT id AS film_id, title, rating FROM content.film_work"
FILMS_BY_CHANGE_QUERY = (
    "SELECT id, id AS film_id, title, rating, updated_at FROM content.film_work"
)
RATINGS_QUERY = (
    "SELECT film_id, AVG(rating)::double AS avg_rating, COUNT(*)::int AS rating_count "
    "FROM ugc.ratings GROUP BY film_id"
)

FILM_DIM_FULL = JobSpec("film_dim_full", FILMS_QUERY, FILM_DIM)
FILM_DIM_INCREMENTAL = JobSpec(
    "film_dim_incremental",
    FILMS_BY_CHANGE_QUERY,
    FILM_DIM,
    mode="incremental",
    cursor=CursorColumns("updated_at", "id"),
)
FILM_DIM_PYTHON = replace(FILM_DIM_FULL, job_id="film_dim_python", steps=(film_dim,))
FILM_DIM_STEPS = replace(FILM_DIM_FULL, job_id="film_dim_steps", steps=(normalize_title,))
FILM_RATING_AGG_FULL = JobSpec("film_rating_agg_full", RATINGS_QUERY, FILM_RATING_AGG)
FILM_DIM_DOCUMENTS_FULL = JobSpec("film_dim_documents_full", FILMS_QUERY, FILM_DIM_DOCUMENTS)
FILM_RATING_AGG_DOCUMENTS_FULL = JobSpec(
    "film_rating_agg_documents_full", RATINGS_QUERY, FILM_RATING_AGG_DOCUMENTS
)
