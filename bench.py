"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The index is built and stored once (``index_build``), as the published numbers are taken with
a built index; every other entry is the full run over the whole query table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.operators import claims as cc  # noqa: E402
from quarry.operators import index as ix  # noqa: E402
from quarry.operators import ingest as ig  # noqa: E402
from quarry.operators import outline as ol  # noqa: E402
from quarry.operators import ranked as rk  # noqa: E402
from quarry.plans.suite import citation, common, dense_eval, ingestion, queries  # noqa: E402
from quarry.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    index = lambda: common.listed_index(spark, SF_DIR)
    asked = lambda: common.bench_queries(spark, SF_DIR)
    docs = lambda: common.table(spark, SF_DIR, "documents")
    plain = lambda: docs().selectExpr("doc_id", "text", "1 AS page_count")
    none = lambda: ol.markdown_outline(plain().filter("false"))

    def search(**options):
        of = index if not options.get("use_champions") else lambda: common.champion_index(spark, SF_DIR)
        return lambda: run(rk.search(of(), asked(), k=100, **options))

    jobs = {
        "warmup": lambda: run(ix.postings_table(common.doc_zones(spark, SF_DIR)).limit(10)),
        "index_build": lambda: index(),
        "tfidf": search(scheme="tfidf"),
        "bm25": search(),
        "bm25_title_zone": search(zone_weights=rk.HEADING_WEIGHTS),
        "bm25_champions": search(use_champions=True),
        "dense": lambda: run(dense_eval.dense_run(spark, SF_DIR)),
        "hybrid_rrf": lambda: run(dense_eval._rrf(spark, SF_DIR)),
        "dense_all_pairs": lambda: run(registered["dn4_batch_knn"](spark, SF_DIR)),
        "boolean": lambda: run(registered["bo7_result"](spark, SF_DIR)),
        "phrase": lambda: run(registered["ph1_phrase_search"](spark, SF_DIR)),
        "metric_table": lambda: run(registered["ev4_metric_table"](spark, SF_DIR)),
        "dedupe": lambda: run(ig.dedupe(docs().selectExpr("lang AS org_id", "doc_id AS upload_id", "text AS content"))),
        "chunking": lambda: run(ol.structure(plain(), none())[1]),
        "outline_sections_chunks": lambda: run(ol.structure(ol.assemble_pages(ingestion.pages(spark, SF_DIR))[0])[1]),
        "claim_lexical_check": lambda: run(cc.score_claims(index(), citation.claims(spark, SF_DIR), citation.blocks(spark, SF_DIR))),
        "access_decisions": lambda: run(registered["ac5_access_decisions"](spark, SF_DIR)),
        "admissions": lambda: run(registered["st1_admissions"](spark, SF_DIR)),
    }
    only = set(sys.argv[1:])
    times = {}
    for name, job in jobs.items():
        if only and name not in only | {"index_build"}:
            continue
        t0 = time.time()
        job()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    times.pop("warmup", None)
    n_queries = asked().count()
    rate = {q: round(times[q] * 1000 / n_queries, 2) for q in ("tfidf", "bm25", "bm25_title_zone", "bm25_champions", "dense", "hybrid_rrf") if q in times}
    print(json.dumps({
        "metric": "total seconds over the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": CPUS, "n_queries": n_queries, "n_docs": docs().count(), "ms_per_query": rate,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
