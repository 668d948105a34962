"""Command line: fetch, build, ask, eval, glossary, serve."""

from __future__ import annotations

import argparse
import json
import sys

from clauseforge.config import Settings, load_env
from clauseforge.session import local_session


def _one(spark, question: str):
    return spark.createDataFrame([("q", question)], "qid string, question string")


def build(spark, args, settings) -> int:
    from pyspark.sql import functions as F

    from clauseforge.engine import build_index
    from clauseforge.sources import archives

    manifest = archives.load_manifest(spark, args.manifest)
    parts = archives.word_parts(spark, args.archives).join(manifest.select("spec_id", "filename"), F.col("archive").endswith(F.col("filename")))
    build_index(parts, manifest.select("spec_id", "version", "release"), settings.index_dir, settings)
    return 0


def ask(spark, args, settings) -> int:
    from clauseforge import service

    engine = service.engine(spark, settings)
    out = service.ask(engine, args.question, args.k, None, args.entailment, diagnostics=args.verbose)
    if args.json:
        print(json.dumps(out, ensure_ascii=False))
        return 0
    print(out["answer"])
    for r in out["sources"]:
        print(f"[S{r['n']}] {r['citation']}")
    if args.verbose:
        print(json.dumps({k: out[k] for k in ("reason", "groundedness", "diagnostics", "claims")}, ensure_ascii=False, indent=1))
    return 0


def evaluate(spark, args, settings) -> int:
    from clauseforge.engine import Engine
    from clauseforge.sources.archives import load_golden

    golden = load_golden(spark, args.golden).withColumnRenamed("id", "qid")
    golden = golden.limit(args.limit) if args.limit else golden
    found = Engine(spark, settings.index_dir, settings).evaluate(golden, args.entailment)
    report = {
        "config": {"reranker": settings.retrieval.reranker, "embeddings": settings.embeddings, "llm": settings.llm, "min_top": settings.guard.min_top, "min_support": settings.guard.min_support, "min_overlap": settings.guard.min_overlap},
        "summary": found["summary"].first().asDict(),
        "retrieval_ablation": [r.asDict() for r in found["ablation"].sort("mode").collect()],
        "items": [r.asDict() for r in found["items"].sort("qid").collect()],
    }
    text = json.dumps(report, ensure_ascii=False)
    print(text)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(text)
    return 0


def fetch(spark, args, settings) -> int:
    from clauseforge.sources.archives import fetch as fetched

    rows = fetched(spark, args.mirror, args.specs, args.archives, args.manifest, args.release)
    print(f"{rows} archives")
    return 0 if rows else 1


def serve(spark, args, settings) -> int:
    from clauseforge import service

    service.serve(service.engine(spark, settings), args.host, args.port)
    return 0


def glossary(spark, args, settings) -> int:
    from clauseforge.sources import store

    lexicon = store.load(spark, settings.index_dir)["lexicon"]
    rows = (store.lookup(lexicon, args.term) if args.term else lexicon.sort("acronym", "ord")).collect()
    for r in rows:
        print(f"{r.acronym}\t{r.expansion}")
    return 0 if rows else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clauseforge")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build")
    p.add_argument("--manifest", required=True)
    p.add_argument("--archives", required=True)
    p.set_defaults(run=build)
    p = sub.add_parser("ask")
    p.add_argument("question")
    p.add_argument("-k", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--entailment", action="store_true")
    p.set_defaults(run=ask)
    p = sub.add_parser("eval")
    p.add_argument("--golden", required=True)
    p.add_argument("--limit", type=int)
    p.add_argument("--out")
    p.add_argument("--entailment", action="store_true")
    p.set_defaults(run=evaluate)
    p = sub.add_parser("fetch")
    p.add_argument("--mirror", required=True, help="folder of listings and archives, on any file system")
    p.add_argument("--specs", nargs="+", required=True)
    p.add_argument("--release", type=int)
    p.add_argument("--archives", required=True)
    p.add_argument("--manifest", required=True)
    p.set_defaults(run=fetch)
    p = sub.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p.set_defaults(run=serve)
    p = sub.add_parser("glossary")
    p.add_argument("term", nargs="?")
    p.set_defaults(run=glossary)
    args = parser.parse_args(argv)
    load_env(".env")
    try:
        return args.run(local_session(), args, Settings.from_env())
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
