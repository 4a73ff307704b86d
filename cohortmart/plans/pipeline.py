"""The batch job: dumps to Parquet (bronze), raw tables (silver: those Parquet files, read in place), marts (gold)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cohortmart.operators.marts import Names, best_plays, canonical, item_user_sets, stage_scores, user_topk
from cohortmart.operators.quality import WHILE_WRITING, observed_report
from cohortmart.sources.dump import read_insert_dump
from cohortmart.sources.files import load_raw, read_or_none, save_observed, save_table, scratch_removed, table_counts, table_path, write_sharded

PHASES = ("bronze", "silver", "gold")


@dataclass
class Job:
    """Where a run reads and writes, and what its tables are called there (table -> file or folder name)."""

    dump_dir: str
    parquet_dir: str
    warehouse_dir: str
    tables: dict[str, str] = field(default_factory=lambda: {"scores": "scores", "items": "osu_beatmaps", "item_sets": "osu_beatmapsets"})
    names: Names = field(default_factory=Names)
    top_k: int = 100

    def at(self, name: str) -> str:
        return f"{self.warehouse_dir}/{name}"


def dump_to_parquet(spark: SparkSession, dump: str, path: str, table: str, file_rows: int = 2_000_000, row_group_rows: int = 500_000, mode: str = "overwrite") -> None:
    """One table of a dump as sharded Parquet; mode "ignore" keeps a table that is there already."""
    write_sharded(read_insert_dump(spark, dump, table), path, file_rows, row_group_rows, mode=mode)


def bronze(spark: SparkSession, job: Job) -> dict[str, str]:
    """Dumps that exist become sharded Parquet; the others are skipped. table -> what was done."""
    done = {}
    for name, source in job.tables.items():
        try:
            dump_to_parquet(spark, f"{job.dump_dir}/{source}.sql", f"{job.parquet_dir}/{source}", source)
        except Exception as error:  # noqa: BLE001 - a missing dump is no failure, anything else is
            if "PATH_NOT_FOUND" not in str(error):
                raise
            done[name] = "skipped: no dump"
            continue
        done[name] = "written"
    return done


def raw_table(spark: SparkSession, job: Job, name: str) -> DataFrame | None:
    """The raw table, from <parquet>/<table>/*.parquet; None without such files."""
    source = job.tables[name]
    return None if read_or_none(spark, f"{job.parquet_dir}/{source}") is None else load_raw(spark, table_path(spark, job.parquet_dir, source))


def silver(spark: SparkSession, job: Job) -> dict[str, str]:
    """Which raw tables there are. They are not copied."""
    return {name: "skipped: no Parquet" if raw_table(spark, job, name) is None else "read in place" for name in job.tables}


def gold(spark: SparkSession, job: Job) -> dict[str, str]:
    raw = raw_table(spark, job, "scores")
    if raw is None:
        return {"scores": "skipped: no raw table"}
    staged = stage_scores(canonical(raw, job.names))
    # The checks of single rows are counted by the jobs that write the marts.
    best, seen = save_observed(best_plays(staged), job.at("best_plays"), **WHILE_WRITING["best"]())
    save_table(user_topk(best, job.top_k), job.at("user_topk"))
    _, sets_seen = save_observed(item_user_sets(best), job.at("item_user_sets"), **WHILE_WRITING["sets"]())
    save_table(observed_report(spark, {"best": seen, "sets": sets_seen}), job.at("quality"))
    return {name: "written" for name in ("best_plays", "user_topk", "item_user_sets")}


def run_pipeline(spark: SparkSession, job: Job, phases: tuple[str, ...] = PHASES, dry_run: bool = False) -> DataFrame:
    """table, n_rows of all tables after the phases; with dry_run nothing is written."""
    steps = {"bronze": bronze, "silver": silver, "gold": gold}
    unknown = set(phases) - set(steps)
    if unknown:
        raise ValueError(f"unknown phases {sorted(unknown)}")
    for phase in PHASES:
        if phase in phases and not dry_run:
            with scratch_removed(spark):
                steps[phase](spark, job)
    raw = {f"raw_{t}": raw_table(spark, job, t) for t in job.tables}
    marts = {t: read_or_none(spark, job.at(t)) for t in ("best_plays", "user_topk", "item_user_sets")}
    return table_counts(raw | marts, spark)


if __name__ == "__main__":
    import argparse

    parser = argparse.ArgumentParser(description=__doc__)
    for option in ("--dumps", "--parquet", "--warehouse"):
        parser.add_argument(option, required=True)
    parser.add_argument("--phase", default=",".join(PHASES))
    parser.add_argument("--dry-run", action="store_true")
    a = parser.parse_args()
    session = SparkSession.builder.appName("score-marts").getOrCreate()
    run_pipeline(session, Job(a.dumps, a.parquet, a.warehouse), tuple(a.phase.split(",")), a.dry_run).show(truncate=False)
