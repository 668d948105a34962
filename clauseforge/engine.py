"""The engine over an index: whole batches of questions in, answers out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseforge.config import Settings
from clauseforge.functions import text as T
from clauseforge.operators import answers as A
from clauseforge.operators import clauses as C
from clauseforge.operators import evaluate as E
from clauseforge.operators import index as I
from clauseforge.operators import plugins as P
from clauseforge.operators import retrieval as R
from clauseforge.operators import verify as V
from clauseforge.operators.segments import running
from clauseforge.session import settled
from clauseforge.sources import docx, store

PREFIX = "Spec "
INSUFFICIENT = "INSUFFICIENT_CONTEXT"
#: Instructions for a plugged-in model: what the verifier can check is all that it may write.
SYSTEM = (
    "Answer from the numbered sources alone; ignore what you know from elsewhere. Write one statement a line "
    "and end each line with the markers of its sources, such as [S1] or [S2][S3]. Copy names, numbers and "
    f"references letter by letter. If the sources do not answer the question, write {INSUFFICIENT} and nothing else."
)

#: For a second look at claims: one line each, and nothing else.
JUDGE = (
    "You check numbered claims against the passages that they cite. For every claim write one line, its number, a "
    "colon, and SUPPORTED if the cited passages state it in full, else NOT_SUPPORTED. Write nothing else."
)


def build_index(parts: DataFrame, specs: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """Word parts (spec_id, part, name, content) and specs (spec_id, version, release) to an index below ``path``."""
    clauses = C.clauses(docx.read_blocks(parts))
    c = settings.chunking
    chunks = C.chunks(clauses, target=c.target, limit=c.limit, overlap=c.overlap).join(specs, "spec_id")
    forward, reverse = C.lexicon(C.entries(clauses))
    indexed = positioned(chunks)
    name, made = settings.embeddings, P.resolve(P.EMBEDDINGS, settings.embeddings)
    vectors = made.passages(indexed) if made else None
    store.build(indexed, path, forward, reverse, latent_dims=settings.latent_dims if name == "latent" else 0, embeddings=name, vectors=vectors)


def positioned(chunks: DataFrame) -> DataFrame:
    """Chunks with their place in the index and the text that is indexed: header, blank line, body."""
    head = T.header(PREFIX, F.col("spec_id"), F.col("version"), F.col("release"), F.col("clause"), F.col("heading"), F.col("part"), F.col("parts"), F.col("breadcrumb"))
    offsets = chunks.groupBy("spec_id").agg(F.count("*").alias("_n"))
    # One row a specification meets in one task, not the chunks.
    starts = offsets.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("spec_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rows = running(chunks, ["spec_id"], ["clause_no", "part"], _row=("sum", F.lit(1))).join(starts, "spec_id")
    rows = rows.withColumn("pos", (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_start", "_row")
    return rows.withColumn("indexed", F.concat(head, F.lit("\n\n"), "text")).withColumn("header", head)


class Engine:
    """Answers from one index; a reranker, embeddings and a language model can be plugged in or named in the settings."""

    def __init__(self, spark, path: str, settings: Settings = Settings(), reranker: P.Reranker | None = None, embeddings: P.Embeddings | None = None, llm: P.LanguageModel | None = None):
        self.settings, self.tables = settings, store.load(spark, path)
        self.reranker = reranker or P.resolve(P.RERANKERS, settings.retrieval.reranker)
        self.llm = llm or P.resolve(P.MODELS, settings.llm)
        #: The index says what its vectors are; given embeddings take their place.
        self.indexed = self.tables["meta"].first().embeddings
        self.embeddings = embeddings or P.resolve(P.EMBEDDINGS, self.indexed)
        self.vectors = embeddings.passages(self.tables["chunks"]) if embeddings else self.tables["vectors"]

    def _second(self, questions: DataFrame) -> DataFrame | None:
        """The dense list of the questions; None where there are no vectors, so that TF-IDF is the second list."""
        if self.embeddings is not None:
            asked = self.embeddings.questions(questions)
        elif self.indexed == "latent":
            asked = I.encoded(questions, self.tables["terms"], self.tables["stats"], self.tables["basis"])
        else:
            return None
        return R.dense_search(self.vectors, asked, self.settings.retrieval.candidates)

    def _inputs(self, questions: DataFrame, mode: str):
        expansions = None if mode == "dense" else C.expand(questions, self.tables["lexicon"], self.tables["reverse"])
        return self._second(questions) if mode in ("hybrid", "dense") else None, expansions

    def retrieve(self, questions: DataFrame, mode: str = "hybrid", rerank: bool = True, wanted: DataFrame | None = None, k: int | None = None) -> DataFrame:
        s = self.settings.retrieval
        second, expansions = self._inputs(questions, mode)
        score = self.reranker.score if self.reranker else None
        return R.retrieve(self.tables["chunks"], questions, self.tables["terms"], mode, rerank and s.reranker != "none", second, expansions, wanted, s.candidates, s.depth, k or s.final_k, s.parts_per_clause, s.window, tables=self.tables, reranker=score, rrf_k=s.rrf_k)

    def diagnostics(self, questions: DataFrame, mode: str = "hybrid", hits: DataFrame | None = None) -> DataFrame:
        """(qid, expansions, specs, clauses, bm25, dense, candidates, pinned, hits) of a retrieval."""
        second, expansions = self._inputs(questions, mode)
        lists = R.ranked_lists(self.tables["chunks"], questions, mode, second, expansions, self.settings.retrieval.candidates, "indexed", self.tables)
        return R.diagnostics(questions, lists, self.retrieve(questions, mode) if hits is None else hits, expansions)

    def ask(self, questions: DataFrame, wanted: DataFrame | None = None, k: int | None = None, entailment: bool = False) -> dict[str, DataFrame]:
        """answers, hits, gates, sources and claims of questions (qid, question).

        ``entailment``: the language model judges the claims once more; without one that is refused.
        """
        if entailment and self.llm is None:
            raise ValueError("entailment needs a language model")
        g, chunks = self.settings.guard, self.tables["chunks"]
        hits = settled(self.retrieve(questions, wanted=wanted, k=k))  # a few rows a question, read by all that follows
        unknown = R.unknown_terms(questions, chunks, vocabulary=self.tables["terms"].select("term")) if g.premise_check else None
        missing = R.missing_specs(questions, chunks) if g.premise_check else None
        gates = settled(A.gate(A.signals(questions, hits), unknown, missing, g.min_top, g.min_support, g.min_overlap))
        body = hits.join(chunks.select("pos", "version", "release", "heading", "breadcrumb", "header", "text"), "pos")
        used = A.within_budget(body, F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), "header", F.lit("\n"), "text"))
        used = settled(used.join(gates.where("answerable").select("qid"), "qid", "left_semi"))
        lines = A.extractive(used, R.weighted_terms(questions, self.tables["terms"]))
        raw = lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line", "text"))), lambda x: x["text"]), "\n").alias("answer"))
        if self.llm is not None:
            raw = self._generated(questions, used, raw)
        seen = used.select("qid", "n", F.concat("header", F.lit("\n"), "text").alias("text"))
        claims = settled(V.verified(settled(V.claims(raw)), seen, self.tables["terms"], g.min_claim_support))
        if entailment:
            claims = settled(V.entailment(claims, self._judged(claims, seen)))
        cite = T.citation(PREFIX, F.col("spec_id"), F.col("version"), F.col("clause"), F.col("heading"))
        sources = used.select("qid", "n", "pos", "spec_id", "version", "release", "clause", "heading", "breadcrumb", cite.alias("citation"), F.round("score", 4).alias("score"), "text")
        return {"answers": A.assembled(questions, gates, claims, g.drop_unverified), "hits": hits, "gates": gates, "sources": sources, "claims": claims}

    def _generated(self, questions: DataFrame, used: DataFrame, extracted: DataFrame) -> DataFrame:
        block = F.concat(F.lit("[S"), F.col("n").cast("string"), F.lit("] "), "header", F.lit("\n"), "text")
        context = used.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n---\n\n").alias("context"))
        prompt = F.concat(F.lit("SOURCES:\n\n"), "context", F.lit("\n\nQUESTION: "), "question")
        replies = P.generated(context.join(questions, "qid").select("qid", prompt.alias("prompt")), self.llm, SYSTEM)
        rows = replies.join(extracted, "qid", "left")
        refused = F.upper("reply").contains(INSUFFICIENT)
        text = F.when(refused, F.lit("")).when(F.trim("reply") != "", F.col("reply")).otherwise(F.col("answer"))
        return rows.select("qid", F.coalesce(text, F.lit("")).alias("answer"))

    def _judged(self, claims: DataFrame, seen: DataFrame) -> DataFrame:
        """(qid, reply): the language model's verdicts on a question's claims, numbered in order."""
        number = F.row_number().over(Window.partitionBy("qid").orderBy("claim_no"))
        line = F.concat(number.cast("string"), F.lit(": "), "text", F.lit(" "), F.array_join(F.transform("citations", lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))), ""))
        joined = lambda df, key, text, between, name: df.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), text.alias("t")))), lambda x: x["t"]), between).alias(name))
        listed = joined(claims.withColumn("line", line), "claim_no", F.col("line"), "\n", "listed")
        passages = joined(seen, "n", F.concat(F.lit("[S"), F.col("n").cast("string"), F.lit("] "), "text"), "\n\n", "passages")
        prompt = F.concat(F.lit("PASSAGES:\n\n"), "passages", F.lit("\n\nCLAIMS:\n"), "listed")
        return P.generated(listed.join(passages, "qid").select("qid", prompt.alias("prompt")), self.llm, JUDGE).select("qid", F.coalesce("reply", F.lit("")).alias("reply"))

    def evaluate(self, golden: DataFrame, entailment: bool = False) -> dict[str, DataFrame]:
        """items, summary and ablation over golden questions (qid, question, expect_*, must_*)."""
        questions = golden.select("qid", "question")
        truth = E.truth(golden)
        out = self.ask(questions, entailment=entailment)
        offered = out["sources"].groupBy("qid").agg(F.count("*").alias("offered"))
        cited = out["claims"].select("qid", F.explode_outer("citations").alias("n")).groupBy("qid").agg(F.array_sort(F.collect_set("n")).alias("cited"))
        rows = out["answers"].join(offered, "qid", "left").join(cited, "qid", "left").withColumns({"offered": F.coalesce("offered", F.lit(0)), "cited": F.coalesce("cited", F.array().cast("array<int>"))})
        checks = E.item_checks(rows, golden)
        ranks = E.rank_of(out["hits"], truth).withColumn("has_truth", F.lit(True))
        items = checks.join(rows.select("qid", "answer", "reason", "groundedness", "claims", (F.col("claims") - F.col("kept")).alias("dropped")), "qid").join(ranks, "qid", "left").withColumn("has_truth", F.coalesce("has_truth", F.lit(False)))
        items, modes = settled(items), None
        for mode, rerank in (("bm25", False), ("dense", False), ("hybrid", False), ("hybrid", True)):
            one = E.rank_of(self.retrieve(questions, mode, rerank), truth).withColumn("mode", F.lit(mode + "+rerank" * rerank))
            modes = one if modes is None else modes.unionByName(one)
        return {"items": items, "summary": E.summary(items), "ablation": E.retrieval_metrics(modes)}
