"""What a front end calls: one question or look-up at a time, as plain dictionaries; and a small JSON server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F

from clauseforge.config import Settings
from clauseforge.engine import Engine
from clauseforge.sources import store

#: Lengths of a question, and numbers of hits that may be asked for.
QUESTION_CHARS, HITS = (3, 1000), (1, 20)


def engine(spark, settings: Settings) -> Engine:
    return Engine(spark, settings.index_dir, settings)


def health(e: Engine) -> dict:
    """Size and make of the index."""
    specs = [r.asDict() for r in store.specs(e.tables["chunks"]).sort("spec_id").collect()]
    return {"status": "ok", "chunks": sum(s["chunks"] for s in specs), "specs": specs, "embeddings": e.indexed, "reranker": e.settings.retrieval.reranker, "llm": e.llm.name if e.llm else "none"}


def ask(e: Engine, question: str, k: int | None = None, specs: list[str] | None = None, entailment: bool = False, diagnostics: bool = False) -> dict:
    """The answer to one question, with its sources and claims; ValueError for what may not be asked."""
    question = question.strip()
    if not QUESTION_CHARS[0] <= len(question) <= QUESTION_CHARS[1]:
        raise ValueError(f"a question has {QUESTION_CHARS[0]} to {QUESTION_CHARS[1]} characters")
    if k is not None and not HITS[0] <= k <= HITS[1]:
        raise ValueError(f"between {HITS[0]} and {HITS[1]} hits can be asked for")
    spark = e.tables["chunks"].sparkSession
    asked = spark.createDataFrame([("q", question)], "qid string, question string")
    wanted = spark.createDataFrame([("q", s) for s in specs], "qid string, spec_id string") if specs else None
    out = e.ask(asked, wanted, k, entailment)
    answer = out["answers"].drop("qid").first().asDict()
    rows = lambda df, *by: [r.asDict() for r in df.drop("qid").sort(*by).collect()]
    sources, claims = rows(out["sources"], "n"), rows(out["claims"], "claim_no")
    cited = {n for c in claims if c["supported"] for n in c["citations"]}
    shown = [s for s in sources if s["n"] in cited] or sources
    found = {"question": question, **answer, "sources": shown, "claims": claims}
    return found | ({"diagnostics": e.diagnostics(asked, hits=out["hits"]).drop("qid").first().asDict()} if diagnostics else {})


def glossary(e: Engine, term: str) -> dict:
    """The expansions of an acronym; LookupError if there is none."""
    found = [r.expansion for r in store.lookup(e.tables["lexicon"], term).collect()]
    if not found:
        raise LookupError(f"no expansion of {term!r}")
    return {"term": term.upper(), "expansions": found}


def clause(e: Engine, spec_id: str, number: str) -> dict:
    """The whole text of a clause; LookupError if there is none."""
    row = store.clause_text(e.tables["chunks"], spec_id, number).first()
    if row is None:
        raise LookupError(f"no clause {number!r} of {spec_id!r}")
    head = e.tables["chunks"].where((F.col("spec_id") == spec_id) & (F.col("clause") == number)).sort("part").select("heading", "breadcrumb").first()
    return row.asDict() | head.asDict()


def answered(e: Engine, method: str, path: str, body: dict) -> tuple[int, dict]:
    """Status and reply of a request."""
    parts = [unquote(p) for p in urlparse(path).path.strip("/").split("/")]
    try:
        if method == "GET" and parts == ["api", "health"]:
            return 200, health(e)
        if method == "GET" and len(parts) == 3 and parts[:2] == ["api", "glossary"]:
            return 200, glossary(e, parts[2])
        if method == "GET" and len(parts) == 4 and parts[:2] == ["api", "clause"]:
            return 200, clause(e, parts[2], parts[3])
        if method == "POST" and parts == ["api", "ask"]:
            return 200, ask(e, str(body.get("question") or ""), body.get("top_k"), body.get("specs"), bool(body.get("entailment")))
    except LookupError as x:
        return 404, {"detail": str(x)}
    except (ValueError, TypeError) as x:
        return 422, {"detail": str(x)}
    return 404, {"detail": "no such path"}


def serve(e: Engine, host: str, port: int) -> None:
    """Answer requests until interrupted."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                status, out = answered(e, method, self.path, body if isinstance(body, dict) else {})
            except json.JSONDecodeError as x:
                status, out = 422, {"detail": str(x)}
            data = json.dumps(out, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.reply("GET")

        def do_POST(self) -> None:
            self.reply("POST")

    HTTPServer((host, port), Handler).serve_forever()
