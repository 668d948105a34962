"""What a caller can plug in: embeddings, rerankers and language models."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.functions import text as T


class Embeddings(ABC):
    """Vectors for passages (pos, indexed) and questions (qid, question)."""

    name: str

    @abstractmethod
    def passages(self, chunks: DataFrame) -> DataFrame:
        """(pos, vector)"""

    @abstractmethod
    def questions(self, questions: DataFrame) -> DataFrame:
        """(qid, vector)"""


class ModelEmbeddings(Embeddings):
    """A model loaded once in each worker; ``load`` returns a function from texts to vectors."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], list]]):
        self.name, self.load = name, load

    def _encode(self, query: bool):
        load, prefix = self.load, T.model_prefix(self.name, query)

        @F.pandas_udf("array<double>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series([[float(x) for x in v] for v in model([prefix + t for t in texts])])

        return encode

    def passages(self, chunks):
        return chunks.select("pos", T.unit(self._encode(False)("indexed")).alias("vector"))

    def questions(self, questions):
        return questions.select("qid", T.unit(self._encode(True)("question")).alias("vector"))


class Reranker(ABC):
    name: str

    @abstractmethod
    def score(self, pairs: DataFrame) -> DataFrame:
        """Rows (qid, pos, question, passage) with a score between 0 and 1."""


class ModelReranker(Reranker):
    """A cross-encoder loaded once in each worker; ``load`` returns a function from pairs to logits."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
        self.name, self.load = name, load

    def score(self, pairs):
        load = self.load

        @F.pandas_udf("double")
        def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for questions, passages in batches:
                yield pd.Series([float(x) for x in model(list(zip(questions, passages)))])

        return pairs.withColumn("score", T.sigmoid(logits("question", "passage")))


class LanguageModel(ABC):
    """Called once a question inside the workers; an exception counts as no answer."""

    name: str

    @abstractmethod
    def complete(self, system: str, prompt: str) -> str: ...


def generated(rows: DataFrame, model: LanguageModel, system: str) -> DataFrame:
    """Rows (qid, prompt) with the model's reply, null where it failed."""

    @F.pandas_udf("string")
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompt):
            try:
                return model.complete(system, prompt)
            except Exception:  # noqa: BLE001 - whatever a provider raises, the extractive way remains
                return None

        for prompts in batches:
            yield prompts.map(one)

    return rows.withColumn("reply", reply("prompt"))


class ChatModel(LanguageModel):
    """A chat endpoint that takes and gives JSON; ``kind`` is "openai" or "ollama"."""

    def __init__(self, url: str, model: str, key: str | None = None, kind: str = "openai", temperature: float = 0.0, max_tokens: int = 900, timeout: int = 120):
        self.url, self.name, self.key, self.kind = url, model, key, kind
        self.temperature, self.max_tokens, self.timeout = temperature, max_tokens, timeout

    def complete(self, system, prompt):
        import json
        import urllib.request

        body = {"model": self.name, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "stream": False}
        if self.kind == "ollama":
            body["options"] = {"temperature": self.temperature, "num_predict": self.max_tokens}
        else:
            body |= {"temperature": self.temperature, "max_tokens": self.max_tokens}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
            out = json.load(r)
        return out["message"]["content"] if self.kind == "ollama" else out["choices"][0]["message"]["content"]


def chat(name: str, model: str | None = None) -> LanguageModel:
    """A chat model by the name of its provider; its model and key come from the environment."""
    url, key, default = PROVIDERS[name]
    model = model or os.environ.get("CLAUSEFORGE_MODEL") or default
    return ChatModel(os.environ.get(f"{name.upper()}_URL") or url, model, os.environ.get(key) if key else None, "ollama" if name == "ollama" else "openai")


def automatic() -> LanguageModel | None:
    """The first provider whose key is set, or none."""
    return next((chat(name) for name, (_, key, _) in PROVIDERS.items() if key and os.environ.get(key)), None)


#: Address, variable of the key, and default model of each provider.
PROVIDERS = {
    "groq": ("https://api.groq.com/openai/v1/chat/completions", "GROQ_API_KEY", "llama-3.3-70b-versatile"),
    "openai": ("https://api.openai.com/v1/chat/completions", "OPENAI_API_KEY", "gpt-4o-mini"),
    "ollama": ("http://localhost:11434/api/chat", None, "llama3.1"),
}
#: "lexical" is the built-in score, "none" the share of the best fusion. Callers may add their own.
RERANKERS: dict[str, Callable[[], Reranker] | None] = {"lexical": None, "none": None}
EMBEDDINGS: dict[str, Callable[[], Embeddings] | None] = {"latent": None, "none": None}
MODELS: dict[str, Callable[[], LanguageModel | None] | None] = {"none": None, "auto": automatic, **{name: partial(chat, name) for name in PROVIDERS}}


def resolve(registry: dict, name: str):
    """What is registered under ``name``; ValueError for an unknown one."""
    if name not in registry:
        raise ValueError(f"unknown: {name!r}; known: {sorted(registry)}")
    made = registry[name]
    return made() if made else None
