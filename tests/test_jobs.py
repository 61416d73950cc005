from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest

from marts.operators import Cursor, CursorColumns, GroupBy, backlog, film_dim, normalize_title
from marts.plans import (
    JobSpec,
    MartTable,
    RunHistory,
    Step,
    TargetSpec,
    error_summary,
    latest_runs,
    run_job,
)
from marts.plans import job as job_module

T0 = datetime(2024, 1, 1)
NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
ITEMS = TargetSpec("items", ("id",), "id INT NOT NULL, title STRING", buckets=4)
BY_CHANGE = CursorColumns("changed", "id")


def source(spark, rows, name="job_items"):
    df = spark.createDataFrame(rows, "id int, title string, changed timestamp_ntz")
    df.createOrReplaceTempView(name)
    return f"SELECT * FROM {name}"


def incremental(query, **options):
    return JobSpec("items", query, ITEMS, mode="incremental", cursor=BY_CHANGE, **options)


def items(spark, root, spec=ITEMS):
    return sorted(tuple(r) for r in MartTable(spark, root, spec).read().select("id", "title").collect())


def ten(changed=None):
    return [(i, f"t{i}", (changed or {}).get(i, T0)) for i in range(10)]


@pytest.mark.parametrize(
    "options",
    [
        {"mode": "incremental"},
        {"mode": "sometimes"},
        {"max_rows": 5},
        {"mode": "incremental", "cursor": BY_CHANGE, "max_rows": 0},
        {"mode": "incremental", "cursor": BY_CHANGE, "null_keys": "x"},
        {"mode": "incremental", "cursor": BY_CHANGE, "overlap": timedelta(-1)},
        {"steps": ("module.path",)},
        {"steps": (Step(film_dim, target=ITEMS), normalize_title)},
    ],
)
def test_job_arguments(options):
    with pytest.raises(ValueError):
        JobSpec("j", "SELECT 1", ITEMS, **options)


def test_names(spark):
    for name in ("", "a/b", "es:films", ".."):
        with pytest.raises(ValueError):
            TargetSpec(name, ("id",), "id INT")
    with pytest.raises(ValueError):
        TargetSpec("t", (), "id INT")
    with pytest.raises(ValueError):
        MartTable(spark, "/tmp/x", TargetSpec("t", ("nope",), "id INT"))


def test_full_job_twice(spark, root):
    job = JobSpec("items", source(spark, ten()), ITEMS)
    first, second = run_job(spark, job, root), run_job(spark, job, root)
    assert (first.rows_read, first.rows_written) == (second.rows_read, second.rows_written) == (10, 10)
    assert items(spark, root) == [(i, f"t{i}") for i in range(10)]


def test_checkpoint_cycle(spark, root):
    query = source(spark, ten())
    first = run_job(spark, incremental(query), root)
    assert (first.rows_read, first.cursor.id) == (10, "9")
    idle = run_job(spark, incremental(query), root)
    assert (idle.rows_read, idle.rows_written, idle.cursor) == (0, 0, first.cursor)
    assert idle.version == first.version
    # One row touched: one row read.
    touched = T0 + timedelta(minutes=1)
    source(spark, [(i, "new" if i == 4 else t, c) for i, t, c in ten({4: touched})])
    once = run_job(spark, incremental(query), root)
    assert (once.rows_read, once.rows_written, once.cursor.id) == (1, 1, "4")
    assert items(spark, root)[4] == (4, "new")


@pytest.mark.parametrize("staged", [False, True])
@pytest.mark.parametrize("max_rows", [1, 3, 100])
def test_drain_equals_full(spark, root, max_rows, staged):
    rows = [(i, f"t{i}", T0 + timedelta(days=i // 4)) for i in range(9)]
    job = incremental(source(spark, rows), max_rows=max_rows, stage_backlog=staged)
    result = run_job(spark, job, root)
    assert result.rows_read == result.rows_written == 9
    assert result.slices == -(-9 // max_rows)
    assert items(spark, root) == [(i, f"t{i}") for i in range(9)]
    assert run_job(spark, job, root).rows_read == 0


def test_later_change_wins_across_and_within_slices(spark, root):
    rows = [(1, "late", T0 + timedelta(2)), (1, "early", T0), (2, "b", T0), (2, "c", T0 + timedelta(1))]
    for max_rows in (None, 1, 2):
        run_job(spark, incremental(source(spark, rows), max_rows=max_rows), f"{root}/{max_rows}")
        assert items(spark, f"{root}/{max_rows}") == [(1, "late"), (2, "c")]


def test_stop_and_resume(spark, root):
    job = incremental(source(spark, ten()), max_rows=4)
    first = run_job(spark, job, root, should_stop=lambda: True)
    assert first.stopped and first.rows_read == 4 and len(items(spark, root)) == 4
    second = run_job(spark, job, root)
    assert not second.stopped and second.rows_read == 6 and second.slices == 2
    assert len(items(spark, root)) == 10


def test_crash_between_slices(spark, root, monkeypatch):
    job = incremental(source(spark, ten()), max_rows=4)
    original = MartTable.publish
    calls = []

    def flaky(self, *args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return original(self, *args, **kwargs)

    monkeypatch.setattr(MartTable, "publish", flaky)
    with pytest.raises(OSError):
        run_job(spark, job, root)
    assert len(items(spark, root)) == 4
    assert run_job(spark, job, root).rows_read == 6
    assert items(spark, root) == [(i, f"t{i}") for i in range(10)]
    history = RunHistory(spark, root)
    runs = history.latest("items").collect()
    assert [(r.status, r.rows_read) for r in runs] == [("SUCCESS", 6), ("FAILED", 4)]
    assert runs[1].error_message == "OSError: lost"


def test_steps_that_drop_everything_still_advance(spark, root):
    job = incremental(source(spark, ten()), steps=(lambda d: d.where("id < 0"),))
    result = run_job(spark, job, root)
    assert (result.rows_read, result.rows_written, result.cursor.id) == (10, 0, "9")
    assert run_job(spark, job, root).rows_read == 0
    assert items(spark, root) == []


def test_steps_that_drop_all_rows_of_a_growing_source(spark, root):
    spark.createDataFrame(ten()[:5], "id int, title string, changed timestamp_ntz").write.parquet(
        f"{root}/live"
    )
    steps = (lambda d: d.where("id > 6"),)
    job = incremental(f"SELECT * FROM parquet.`{root}/live`", steps=steps)
    result = run_job(spark, job, root)
    assert (result.rows_read, result.rows_written, result.cursor.id) == (5, 0, "4")
    spark.createDataFrame(ten()[5:], "id int, title string, changed timestamp_ntz").write.mode(
        "append"
    ).parquet(f"{root}/live")
    result = run_job(spark, job, root)
    assert (result.rows_read, result.rows_written, result.cursor.id) == (5, 3, "9")


def test_cursor_is_independent_of_the_steps(spark, root):
    job = incremental(source(spark, ten({9: T0 + timedelta(1)})), steps=(lambda d: d.where("id = 3"),))
    result = run_job(spark, job, root)
    assert (result.cursor.id, result.rows_written) == ("9", 1)


def test_null_cursor_rows(spark, root):
    rows = [*ten(), (10, "n", None), (None, "m", T0)]
    query = source(spark, rows)
    for options in ({}, {"max_rows": 3}, {"max_rows": 3, "stage_backlog": True}):
        with pytest.raises(ValueError, match="2 rows have a NULL"):
            run_job(spark, incremental(query, **options), root)
    assert MartTable(spark, root, ITEMS).versions() == []
    result = run_job(spark, incremental(query, null_keys="skip"), root)
    assert result.rows_read == 10
    # Also when it appears after the first run.
    with pytest.raises(ValueError, match="rows have a NULL"):
        run_job(spark, incremental(query), root)


def test_backdated_rows_need_the_overlap(spark, root):
    query = source(spark, ten({9: T0 + timedelta(hours=3)}))
    run_job(spark, incremental(query), root)
    moved = ten({2: T0 + timedelta(hours=2), 9: T0 + timedelta(hours=3)})
    rows = [(i, "late" if i == 2 else t, c) for i, t, c in moved]
    source(spark, rows)
    missed = run_job(spark, incremental(query), root)
    assert missed.rows_read == 0
    found = run_job(spark, incremental(query, overlap=timedelta(hours=2)), root)
    assert found.rows_read == 2 and items(spark, root)[2] == (2, "late")
    assert found.cursor == missed.cursor


def test_cursor_columns_are_checked_first(spark, root):
    source(spark, ten())
    job = JobSpec(
        "items", "SELECT id, title FROM job_items", ITEMS, mode="incremental", cursor=BY_CHANGE
    )
    with pytest.raises(ValueError, match="changed"):
        run_job(spark, job, root)
    run = RunHistory(spark, root).latest("items").first()
    assert run.status == "FAILED" and "changed" in run.error_message


def test_a_target_that_cannot_be_made_is_a_failed_run(spark, root):
    source(spark, ten())
    broken = TargetSpec("items", ("other",), "item_id INT, title STRING")
    with pytest.raises(ValueError, match="other"):
        run_job(spark, JobSpec("items", "SELECT 1 AS item_id, 'x' AS title", broken), root)
    run = RunHistory(spark, root).latest("items").first()
    assert run.status == "FAILED" and "other" in run.error_message


def test_changed_cursor_type_is_an_error(spark, root):
    query = source(spark, ten())
    run_job(spark, incremental(query), root)
    changed = "SELECT CAST(id AS BIGINT) AS id, title, changed FROM job_items"
    with pytest.raises(ValueError, match="was int"):
        run_job(spark, incremental(changed), root)


def test_order_lost_by_a_step(spark, root):
    """Without the cursor columns a repeated key has no defined last row."""
    rows = [(1, "a", T0), (1, "b", T0 + timedelta(1))]
    query = source(spark, rows)
    with pytest.raises(ValueError, match="repeated"):
        run_job(spark, incremental(query, steps=(lambda d: d.drop("changed"),)), root)
    run_job(spark, incremental(query), root)
    assert items(spark, root) == [(1, "b")]


def test_last_step_overrides_the_target(spark, root):
    other = TargetSpec("others", ("id",), "id INT, title STRING")
    job = JobSpec("j", source(spark, ten()), ITEMS, steps=(Step(normalize_title, target=other),))
    run_job(spark, job, root)
    assert items(spark, root, other)[0] == (0, "TRANSFORMED_t0")
    assert MartTable(spark, root, ITEMS).versions() == []


def test_aggregate_source_is_computed_once_when_staged(spark, root, monkeypatch):
    rows = [(i % 5, f"t{i}", T0 + timedelta(hours=i)) for i in range(40)]
    source(spark, rows)
    query = "SELECT id, max(title) AS title, max(changed) AS changed FROM job_items GROUP BY id"
    read = []
    original = job_module._stage_backlog

    def spy(pending, job, staging):
        out = original(pending, job, staging)
        read.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(job_module, "_stage_backlog", spy)
    result = run_job(spark, incremental(query, max_rows=2), root)
    assert result.rows_read == 5 and result.slices == 3
    assert "Aggregate" not in read[0]


@pytest.mark.parametrize("seed", range(3))
def test_random_histories_end_equal_to_the_source(spark, root, seed):
    """Rows are added and touched, runs are sliced, stopped and resumed; a final
    run always leaves target and source equal."""
    rng = random.Random(seed)
    state: dict[int, tuple[str, datetime]] = {}
    clock = T0
    for step in range(4):
        for _ in range(rng.randrange(1, 12)):
            clock += timedelta(seconds=rng.randrange(2))  # ties are common
            state[rng.randrange(15)] = (f"s{step}-{rng.random():.3f}", clock)
        # Ids touched at the newest second may lie below the cursor's id; the next
        # change must come later, as with a real clock.
        clock += timedelta(seconds=1)
        query = source(spark, [(i, t, at) for i, (t, at) in state.items()])
        job = incremental(
            query, max_rows=rng.choice([None, 2, 5, 50]), stage_backlog=rng.random() < 0.3
        )
        stops = iter([rng.random() < 0.4 for _ in range(50)])
        while run_job(spark, job, root, should_stop=lambda: next(stops)).stopped:
            pass
        assert items(spark, root) == sorted((i, t) for i, (t, _) in state.items())


def test_runs(spark, root):
    history = RunHistory(spark, root)
    assert history.read().collect() == [] and history.latest("a").collect() == []
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for n in range(4):
        history.append("a", "SUCCESS", start + timedelta(hours=n), n, n)
    history.append("b-1.x", "FAILED", start, 5, 0, error="e" * 3000)
    assert [r.rows_read for r in history.latest("a", 2).collect()] == [3, 2]
    last = {r.job_id: r.rows_read for r in history.last_of_every_job().collect()}
    assert last == {"a": 3, "b-1.x": 5}
    summary = error_summary(history.read("b-1.x")).first()
    assert (summary.error_length, summary.error_head) == (1000, "e" * 200)
    for limit in (0, 501):
        with pytest.raises(ValueError):
            latest_runs(history.read(), "a", limit)
    history.reset()
    assert history.read().collect() == []


def test_film_marts(spark, root):
    """The demo marts, relational and document, from schema-qualified tables."""
    from marts.plans import films
    from marts.sources import register_table

    ids = [f"0000000{n}-0000-4000-8000-000000000000" for n in range(3)]
    spark.createDataFrame(
        [
            (ids[0], " One ", "d", Decimal("8.5"), T0, T0),
            (ids[1], "Two", None, None, T0, T0),
            (ids[2], "", None, Decimal("1.0"), T0, T0),
        ],
        "id string, title string, description string, rating decimal(3,1), "
        "created_at timestamp_ntz, updated_at timestamp_ntz",
    ).write.parquet(f"{root}/film_work")
    spark.createDataFrame(
        [(ids[0], 8), (ids[0], 9), (ids[1], 7)], "film_id string, rating int"
    ).write.parquet(f"{root}/ratings")
    register_table(spark, "content.film_work", f"{root}/film_work")
    register_table(spark, "ugc.ratings", f"{root}/ratings")

    def rows(spec, *columns):
        df = MartTable(spark, root, spec).read()
        return sorted(tuple(r) for r in df.select(*columns).collect())

    run_job(spark, films.FILM_DIM_FULL, root, now=NOW)
    plain = [(ids[0], " One ", Decimal("8.5")), (ids[1], "Two", None), (ids[2], "", Decimal("1.0"))]
    assert rows(films.FILM_DIM, "film_id", "title", "rating") == plain
    run_job(spark, films.FILM_DIM_PYTHON, root, now=NOW)
    assert rows(films.FILM_DIM, "film_id", "title", "rating") == plain
    run_job(spark, films.FILM_DIM_STEPS, root, now=NOW)
    titles = [(ids[0], "TRANSFORMED_One"), (ids[1], "TRANSFORMED_Two"), (ids[2], "")]
    assert rows(films.FILM_DIM, "film_id", "title") == titles
    assert run_job(spark, films.FILM_DIM_INCREMENTAL, root, now=NOW).rows_read == 3
    assert run_job(spark, films.FILM_DIM_INCREMENTAL, root, now=NOW).rows_read == 0
    run_job(spark, films.FILM_RATING_AGG_FULL, root, now=NOW)
    assert rows(films.FILM_RATING_AGG, "film_id", "avg_rating", "rating_count") == [
        (ids[0], Decimal("8.50"), 2), (ids[1], Decimal("7.00"), 1)
    ]
    run_job(spark, films.FILM_DIM_DOCUMENTS_FULL, root)
    assert rows(films.FILM_DIM_DOCUMENTS, "film_id", "rating")[0] == (ids[0], 8.5)
    run_job(spark, films.FILM_RATING_AGG_DOCUMENTS_FULL, root)
    assert rows(films.FILM_RATING_AGG_DOCUMENTS, "avg_rating", "rating_count") == [(7.0, 1), (8.5, 2)]
    assert RunHistory(spark, root).last_of_every_job().count() == 7


GROUPED = TargetSpec("totals", ("name",), "name STRING, n BIGINT, total BIGINT")


def grouped_job(**options):
    grouping = GroupBy(("name",), {"n": "count(*)", "total": "sum(v)"})
    return JobSpec(
        "totals", "SELECT * FROM sales", GROUPED, mode="incremental",
        cursor=CursorColumns("at", "id"), group_by=grouping, **options,
    )


def sales(spark, rows):
    columns = "id bigint, name string, v bigint, at timestamp_ntz, _changed_0 string"
    spark.createDataFrame([(*r, "x") for r in rows], columns).createOrReplaceTempView("sales")


@pytest.mark.parametrize("max_rows", [None, 3])
def test_only_affected_groups_are_computed(spark, root, max_rows):
    day = lambda n: datetime(2024, 1, n)
    rows = [(i, "abcde"[i % 5], i, day(1 + i // 5)) for i in range(20)]
    sales(spark, rows)
    run_job(spark, grouped_job(max_rows=max_rows), root)
    rows += [(90, "b", 100, day(9)), (91, "new", 7, day(9)), (92, "b", 1, day(10))]
    # A row of another group changes unseen: that group is not computed again.
    rows[0] = (0, "a", 1000, day(1))
    sales(spark, rows)
    result = run_job(spark, grouped_job(max_rows=max_rows), root)
    assert (result.rows_read, result.rows_written) == (3, 2)
    got = {r["name"]: (r["n"], r["total"]) for r in MartTable(spark, root, GROUPED).read().collect()}
    assert got["b"] == (6, 1 + 6 + 11 + 16 + 101) and got["new"] == (1, 7) and got["a"] == (4, 0 + 5 + 10 + 15)
    assert run_job(spark, grouped_job(max_rows=max_rows), root).rows_written == 0
    run_job(spark, replace(grouped_job(), mode="full", max_rows=None, job_id="all"), root)
    assert content_of(spark, root)["a"] == (4, 1030)


def content_of(spark, root):
    return {r["name"]: (r["n"], r["total"]) for r in MartTable(spark, root, GROUPED).read().collect()}


def test_the_cursor_reaches_the_scan_of_the_changed_keys(spark, root):
    day = datetime(2024, 1, 1)
    data = spark.createDataFrame([(i, "ab"[i % 2], i, day) for i in range(9)], "id bigint, name string, v bigint, at timestamp_ntz")
    data.write.parquet(f"{root}/sales")
    source = spark.read.parquet(f"{root}/sales")
    grouping = GroupBy(("name",), {"n": "count(*)"})
    here = Cursor("2024-01-01T00:00:00.000000", "5", "timestamp_ntz", "bigint")
    out = grouping.of(grouping.affected(source, backlog(source, CursorColumns("at", "id"), here)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "GreaterThanOrEqual(at," in plan and "LeftSemi" in plan
    assert out.count() == 2


def test_groups_need_keys_and_aggregates():
    for keys, aggregates in (((), {"n": "count(*)"}), (("a",), {}), (("a",), {"A": "count(*)"})):
        with pytest.raises(ValueError):
            GroupBy(keys, aggregates)
