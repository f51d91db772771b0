"""python -m bibspark RUN INPUT OUTPUT: a run of plans/workflows.py over a file of records."""

from __future__ import annotations

import argparse
import sys
from functools import partial

from pyspark.sql import SparkSession

from bibspark.plans import remote_runs
from bibspark.plans import workflows as w
from bibspark.sources import records, remote


def main(argv: list[str] | None = None) -> int:
    """0, or 1 if a gate of the run fails."""
    p = argparse.ArgumentParser(prog="bibspark")
    p.add_argument("run", choices=("classify", "metadata", "mods", "collaboration", "temporal", "graph", "figures", "check"))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", choices=("json", "parquet"), default="json")
    p.add_argument("--limit", type=int, default=0, help="first rows of the input; 0: all")
    p.add_argument("--index", help="records of the index (metadata)")
    p.add_argument("--answers", help="folder of landed search answers (classify): expands the corpus by them")
    p.add_argument("--originals", type=int, default=150, help="records that the original corpus must have (classify with --answers)")
    p.add_argument("--start", type=int, default=2015)
    p.add_argument("--end", type=int, default=2024)
    p.add_argument("--window", type=int, default=5)
    p.add_argument("--top", type=int, default=30)
    p.add_argument("--per-type", type=int, default=24)
    p.add_argument("--min-citations", type=float, default=0)
    p.add_argument("--max-papers", type=int, default=14)
    p.add_argument("--min-words", type=int, default=0)
    p.add_argument("--min-figures", type=int, default=0)
    p.add_argument("--language", choices=("any", "english"), default="any")
    p.add_argument("--ledger", help="evidence ledger beside the document (check)")
    p.add_argument("--questions", default="", help="research questions that the ledger must cover, by commas (check)")
    p.add_argument("--figure-report", action="append", help="report beside the document that must have passed (check); may be repeated")
    p.add_argument("--remote", action="store_true", help="ask Crossref and the index (metadata, mods); answers are landed in OUTPUT/landing")
    p.add_argument("--email", default="", help="contact that the index is given")
    p.add_argument("--per-second", type=float, default=remote.PER_SECOND, help="requests a second, all tasks together")
    p.add_argument("--lanes", type=int, default=remote.LANES)
    p.add_argument("--retries", type=int, default=2)
    p.add_argument("--timeout", type=float, default=30.0)
    p.add_argument("--force", action="store_true", help="write files that exist again (mods --remote)")
    p.add_argument("--crossref-base", help="address that a DOI is added to")
    p.add_argument("--index-base", help="address that a work's id is added to")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("bibspark").getOrCreate()
    if a.run == "check":  # input: a folder, or one .tex file
        one = a.input.lower().endswith(".tex")
        folder, _, name = a.input.rpartition("/") if one else (a.input, "", "")
        questions = [q.strip().upper() for q in a.questions.split(",") if q.strip()]
        tables = w.check_folder(spark, folder or ".", f"/{name}" if one else None, a.ledger, questions or None, a.figure_report, min_words=a.min_words, min_figures=a.min_figures, language=a.language)
    elif a.remote:
        return remote_run(spark, a)
    else:
        raw = records.prefix(records.read_records(spark, a.input, ordinal=records.ORDINAL), records.ORDINAL, a.limit)
        tables = {
            "classify": lambda: w.classify_corpus(raw) | (w.expand_from_search(w.identified(raw), records.replay(spark, a.answers), n_originals=a.originals) if a.answers else {}),
            "metadata": lambda: w.extract_metadata(raw, records.read_records(spark, a.index) if a.index else None),
            "mods": lambda: w.export_mods(raw),
            "collaboration": lambda: w.collaboration(raw, a.top),
            "temporal": lambda: w.temporal_topics(raw, a.start, a.end, a.window),
            "graph": lambda: w.bibliometric_graph(raw, a.per_type, a.min_citations),
            "figures": lambda: w.plan_figures(raw, a.start, a.end, a.max_papers),
        }[a.run]()
    w.write(tables, a.output, a.format)
    written = lambda name, df: getattr(spark.read.schema(df.schema), a.format)(f"{a.output.rstrip('/')}/{name}")
    verdicts = [written(name, df) for name, df in tables.items() if "passed" in df.columns]
    return int(any(not df.where("not passed").isEmpty() for df in verdicts))


def remote_run(spark: SparkSession, a: argparse.Namespace) -> int:
    """metadata: paper_metadata as JSON and CSV. mods: a file a record and the manifest; 1 if a record
    has failed."""
    if a.run not in ("metadata", "mods"):
        raise SystemExit(f"--remote is for metadata and mods, not for {a.run}")
    raw = records.prefix(records.read_records(spark, a.input, strict=True, ordinal=records.ORDINAL), records.ORDINAL, a.limit)
    out = a.output.rstrip("/")
    how = {"email": a.email, "index_base": a.index_base, "lanes": a.lanes, "per_second": a.per_second, "retries": a.retries, "get": partial(remote.http_get, timeout=a.timeout, agent=f"bibspark ({a.email})" if a.email else "bibspark")}
    if a.run == "metadata":
        rows = remote_runs.metadata(raw, f"{out}/landing", **how)
        w.write({"paper_metadata": rows}, out, a.format)
        remote_runs.metadata_file(rows).write.mode("overwrite").option("header", True).csv(f"{out}/paper_metadata_csv")
        return 0
    manifest = remote_runs.mods_documents(raw, f"{out}/landing", out, force=a.force, crossref_base=a.crossref_base, **how)
    return int(not manifest.where("status = 'failed'").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
