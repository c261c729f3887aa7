"""From hits to answers: bounded context, prompts, conversation memory, model interface."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftspark.functions import text as T

#: What the model is told once, and how a question reaches it: excerpts first, the question last.
SYSTEM_PROMPT = (
    "Someone searches their own files and wants a short answer out of what was found. "
    "The excerpts are all you know about these files; each begins with its place as path:first-last. "
    "Give the place after every claim. Where the excerpts are silent, answer that they are, and propose other search words."
)
USER_PROMPT = "EXCERPTS\n\n{context}\n\nASKED\n\n{query}"

#: A model: messages in, pieces of text out.
Generator = Callable[[list[dict]], Iterator[str]]


def bounded_context(hits: DataFrame, max_chars: int = 8000) -> DataFrame:
    """``query_id, context, n_blocks``: blocks in order of ``position`` while they fit.

    Each block counts one character more than its length; the first that does not fit
    ends the context. The result of a query is bounded by max_chars.
    """
    block = T.context_block(F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("language"), F.col("text"))
    sized = hits.select("query_id", "position", block.alias("block"))
    used = F.sum(F.length("block") + 1).over(W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    kept = sized.withColumn("_used", F.coalesce(used, F.lit(0))).where(F.col("_used") + F.length("block") <= max_chars)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "block"))), lambda x: x["block"]), "\n\n")
    return kept.groupBy("query_id").agg(joined.alias("context"), F.count("*").alias("n_blocks"))


def prompt_messages(query: Column, context: Column) -> Column:
    """array<struct<role, content>> of a grounded question; nulls count as empty."""
    said = {"query": F.coalesce(query, F.lit("")), "context": F.coalesce(context, F.lit(""))}
    parts = [said[p[1:-1]] if p[:1] == "{" else F.lit(p) for p in re.split(r"(\{\w+\})", USER_PROMPT) if p]
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(SYSTEM_PROMPT)), turn("user", F.concat(*parts)))


def messages(query: str, context: str) -> list[dict]:
    """The same for one question."""
    said = {"system": SYSTEM_PROMPT, "user": USER_PROMPT.format(query=query, context=context)}
    return [{"role": role, "content": content} for role, content in said.items()]


def recent_turns(turns: DataFrame, keep: int = 8, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``keep`` messages of each conversation, ``age`` 1 for the newest."""
    return turns.withColumn("age", F.row_number().over(W.partitionBy(conversation).orderBy(F.desc(turn)))).where(F.col("age") <= keep)


def sources_line(hits: DataFrame) -> DataFrame:
    """``query_id, sources``: the references of the hits in order, joined by commas."""
    ref = T.source_ref(F.col("rel_path"), F.col("start_line"), F.col("end_line"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", ref.alias("ref")))), lambda x: x["ref"]), ", ").alias("sources"))


def whole_answer(generate: Generator, query: str, context: str) -> str:
    """One answer without a memory, as a string."""
    return "".join(generate(messages(query, context)))


class Conversation:
    """Questions and answers with a memory of the last messages."""

    def __init__(self, generate: Generator, keep: int = 8) -> None:
        self.generate, self.keep, self.history = generate, keep, []

    def ask(self, query: str, context: str) -> Iterator[str]:
        said = []
        for piece in self.generate([*self.history, *messages(query, context)]):
            if piece:
                said.append(piece)
                yield piece
        self.history = [*self.history, {"role": "user", "content": query}, {"role": "assistant", "content": "".join(said)}][-self.keep :]

    def clear(self) -> None:
        self.history = []


def http_generator(base_url: str, model: str, temperature: float = 0.1, num_ctx: int = 8192, timeout: float = 60) -> Generator:
    """A local model server that streams JSON lines from ``/api/chat``."""
    import json
    from urllib.request import Request, urlopen

    def generate(messages: list[dict]) -> Iterator[str]:
        body = {"model": model, "messages": messages, "stream": True, "options": {"temperature": temperature, "num_ctx": num_ctx}}
        request = Request(f"{base_url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urlopen(request, timeout=timeout) as reply:
            for line in reply:
                yield json.loads(line).get("message", {}).get("content", "")

    return generate


def server_models(base_url: str, timeout: float = 2) -> list[str] | None:
    """Names of the models a server has; None if it does not answer."""
    import json
    from urllib.request import urlopen

    try:
        with urlopen(f"{base_url}/api/tags", timeout=timeout) as reply:
            return [m["name"] for m in json.load(reply).get("models", [])]
    except (OSError, ValueError, KeyError):
        return None


def fetch_model(base_url: str, model: str, timeout: float = 3600) -> None:
    """Have a server download a model; OSError or ValueError tells why it did not."""
    import json
    from urllib.request import Request, urlopen

    request = Request(f"{base_url}/api/pull", json.dumps({"model": model, "stream": True}).encode(), {"Content-Type": "application/json"})
    with urlopen(request, timeout=timeout) as reply:
        for line in reply:
            if problem := json.loads(line).get("error"):
                raise ValueError(problem)


def model_available(have: list[str] | None, model: str) -> bool:
    """Another tag of the same family counts."""
    return bool(have) and any(h.split(":")[0] == model.split(":")[0] for h in have)
