from .catalog import merge_into
from .job import RunResult, run_job
from .runs import RunHistory, error_summary, latest_runs
from .spec import JobSpec, Step, TargetSpec
from .target import ConcurrentChange, Manifest, MartTable, UpsertResult

__all__ = [
    "ConcurrentChange",
    "JobSpec",
    "Manifest",
    "MartTable",
    "RunHistory",
    "RunResult",
    "Step",
    "TargetSpec",
    "UpsertResult",
    "error_summary",
    "latest_runs",
    "merge_into",
    "run_job",
]
