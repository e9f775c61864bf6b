"""The prompt registry and chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import extract_final

# Prompts are compared across runs, so their wording is part of the results.
SYSTEM = "You are a careful assistant that writes concise, factual text from structured data."
FAITHFUL = " Use only facts that are explicitly stated in the data above. Do not add, infer, or embellish any information, and do not include opinions."
SUBJECTS = {
    "e2e": {
        "plain": "Here is structured information about a restaurant:\n\n{table}\n\nWrite a one- or two-sentence natural-sounding description of this restaurant.",
        "strict": " Every attribute value you mention must match the table exactly. If you are unsure whether something is supported by the table, leave it out.",
        "structured": "Here is structured information about a restaurant:\n\n{table}\n\nFirst, list every attribute-value pair from the table as short bullet points, one per line, prefixed with '- '. Then, on a new line beginning with 'SUMMARY:', write a one- or two-sentence natural-sounding description of the restaurant that uses only those listed facts.",
    },
    "rotowire": {
        "plain": "Here are the box-score statistics of an NBA game:\n\n{table}\n\nWrite a short game summary of roughly 6-8 sentences in the style of a sports report.",
        "strict": " Every number and every player or team name you mention must appear in the table. Do not estimate, round, or invent statistics. If you are unsure of a value, omit it.",
        "structured": "Here are the box-score statistics of an NBA game:\n\n{table}\n\nFirst, list 6-10 key facts from the box score (winner, final score, top performers) as short bullet points, one per line, prefixed with '- ', copying all numbers exactly from the table. Then, on a new line beginning with 'SUMMARY:', write a game summary of roughly 6-8 sentences in the style of a sports report, using only those listed facts.",
    },
}
MARKER = "SUMMARY:"


def _registry() -> dict[str, dict[str, str]]:
    found = {}
    for subject, text in SUBJECTS.items():
        users = {"plain": text["plain"], "faithful": text["plain"] + FAITHFUL, "strict": text["plain"] + FAITHFUL + text["strict"], "structured": text["structured"]}
        for kind, user in users.items():
            found[f"{subject}/{kind}_v1"] = {"system": SYSTEM, "user": user} | ({"extract_marker": MARKER} if kind == "structured" else {})
    return found


PROMPTS = _registry()


def get_spec(name: str) -> dict[str, str]:
    if name not in PROMPTS:
        raise KeyError(f"unknown prompt {name!r}; there are {sorted(PROMPTS)}")
    return PROMPTS[name]


def messages(texts: DataFrame, name: str) -> DataFrame:
    """(ex_id, text) to (ex_id, messages ARRAY<STRUCT<role, content>>) with the table in its slot."""
    spec = get_spec(name)
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return texts.select("ex_id", F.array(say("system", F.lit(spec["system"])), say("user", F.replace(F.lit(spec["user"]), F.lit("{table}"), F.col("text")))).alias("messages"))


def final_texts(raw: DataFrame, name: str) -> DataFrame:
    """(id, output) with what a prompt marks as scratch work taken off; the raw text stays as raw_output."""
    marker = get_spec(name).get("extract_marker")
    return raw.select("id", extract_final(F.col("output"), F.lit(marker)).alias("output"), F.col("output").alias("raw_output"))
