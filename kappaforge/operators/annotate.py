"""The annotation run: notes to labels, concepts, codes and scoped codes.

Stage-wise over all episodes: each step is one pass of prompts through a client
and a table of replies. A client is any object with ``reply(prompts)``, which
takes (episode_id, call, prompt) and adds reply and token columns; replies of a
recorded run are replayed from a table. Loops are bounded and work on the rows
that are still open; a row's error stays in a column and fails no job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaforge.functions import labels as lab
from kappaforge.functions.codes import code_for
from kappaforge.functions.texts import candidate_line, filled, numbered_notes
from kappaforge.operators.mapping import classified
from kappaforge.operators.matching import resolve_selection
from kappaforge.sources.scratch import kept

ROUNDS, CONTINUATIONS = 3, 3

#: default wording; a study's own templates are passed in
TEMPLATES = {
    "extract": "List every diagnosis and procedure in these notes as JSON under the key labels.\n\n{notes}",
    "continue": "Your last reply was cut off. Continue the JSON object from where it ended.\n\n{reply}",
    "choose": "Concepts for '{text}' ({context}):\n{options}\nReply with one concept id, or SEARCH: and a better term.",
    "refine": "No concept was found for '{text}' ({context}). Reply with a simpler term only.",
    "scope": "Choose the principal and at most two secondary rows for diagnoses and procedures, as JSON.\n{candidates}\n\n{notes}",
}


class Client(Protocol):
    def reply(self, prompts: DataFrame) -> DataFrame: ...


@dataclass
class ReplayClient:
    """Replies from a table (prompt_sha, reply, prompt_tokens, completion_tokens), keyed by SHA-256; unknown prompts get null."""

    recorded: DataFrame

    def reply(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("prompt_sha", F.sha2("prompt", 256)).join(self.recorded, "prompt_sha", "left").drop("prompt_sha")


@dataclass
class FunctionClient:
    """Replies from a Python function of the prompt, such as a call of a model's endpoint, in Arrow batches."""

    ask: Callable[[str], str]

    def reply(self, prompts: DataFrame) -> DataFrame:
        ask = self.ask

        def answered(prompt: pd.Series) -> pd.Series:
            def one(p: str) -> str | None:
                try:
                    return ask(p)
                except Exception:  # an unreachable model leaves this row without a reply
                    return None

            return prompt.map(one)

        out = prompts.withColumn("reply", F.pandas_udf(answered, T.StringType())("prompt"))
        return out.withColumn("prompt_tokens", F.length("prompt").cast("long")).withColumn("completion_tokens", F.coalesce(F.length("reply"), F.lit(0)).cast("long"))


@dataclass
class TokenSearch:
    """Terminology search over descriptions (concept_id, term, tag): terms that hold all words, the shortest first."""

    descriptions: DataFrame
    limit: int = 10

    def search(self, terms: DataFrame) -> DataFrame:
        """``terms`` (term, tag or null) with items: an array of (id, term), at most ``limit`` by design of a search page."""
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""))
        asked = terms.select("term", "tag").distinct().withColumn("words", words(F.col("term")))
        # the longest word is the key, so that short common words gather nothing
        key = F.element_at(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
        index = self.descriptions.select("concept_id", F.col("term").alias("name"), F.col("tag").alias("kind"), words(F.col("term")).alias("has")).withColumn("key", F.explode("has"))
        hits = asked.where(F.size("words") > 0).withColumn("key", key).join(index, "key").where((F.size(F.array_except("words", "has")) == 0) & (F.col("tag").isNull() | (F.col("tag") == F.col("kind"))))
        one = hits.groupBy("term", "tag", "concept_id").agg(F.min(F.struct(F.length("name").alias("n"), "name")).alias("best"))
        items = one.groupBy("term", "tag").agg(F.slice(F.array_sort(F.collect_list(F.struct("best.n", F.col("concept_id").cast("string").alias("id"), F.col("best.name").alias("term")))), 1, self.limit).alias("x"))
        found = items.select(F.col("term").alias("_term"), F.col("tag").alias("_tag"), F.transform("x", lambda i: F.struct(i["id"].alias("id"), i["term"].alias("term"))).alias("items"))
        return asked.join(found, (F.col("term") == F.col("_term")) & F.col("tag").eqNullSafe(F.col("_tag")), "left").select("term", "tag", "items")


def simplified(response: DataFrame, items: str = "items") -> DataFrame:
    """Full search responses cut to (id, term): the full name, else the preferred, else the description; items without an id go."""
    one = lambda i: F.struct(i["concept"]["conceptId"].alias("id"), F.coalesce(i["concept"]["fsn"]["term"], i["concept"]["pt"]["term"], i["term"]).alias("term"))
    return response.withColumn(items, F.transform(F.filter(items, lambda i: i["concept"]["conceptId"].isNotNull()), one))


def extract(bundles: DataFrame, client: Client, templates: dict[str, str] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(labels, calls): one row per label with label_idx, and the log of prompts and replies.

    Replies that are no JSON are continued up to CONTINUATIONS times; the parts
    are joined and parsed again. An empty list of labels is no error.
    """
    asked = bundles.select("episode_id", F.lit(0).alias("call"), filled(templates["extract"], notes=numbered_notes(F.col("notes"))).alias("prompt"))
    now = kept(client.reply(asked))
    calls = now
    state = now.select("episode_id", F.coalesce("reply", F.lit("")).alias("whole"))
    done = None
    for turn in range(CONTINUATIONS + 1):
        parsed = kept(state.withColumn("p", lab.parse_reply("whole")))
        good = parsed.where("p.error is null" if turn < CONTINUATIONS else "true")
        done = good if done is None else done.unionByName(good)
        open_rows = parsed.where("p.error is not null")
        if turn == CONTINUATIONS or not open_rows.take(1):
            break
        more = kept(client.reply(open_rows.select("episode_id", F.lit(turn + 1).alias("call"), filled(templates["continue"], reply=F.col("whole")).alias("prompt"))))
        calls = calls.unionByName(more)
        state = open_rows.select("episode_id", "whole").join(more.select("episode_id", "reply"), "episode_id").select("episode_id", F.concat("whole", F.coalesce("reply", F.lit(""))).alias("whole"))
    rows = done.select("episode_id", F.posexplode("p.labels").alias("label_idx", "l")).select("episode_id", "label_idx", "l.*")
    clean = lab.standardised(rows)
    fields = ("text", *lab.FIELDS)
    return clean.select("episode_id", "label_idx", *(lab.tabled(F.col(f)).alias(f) for f in fields)), calls


def ground(labels: DataFrame, client: Client, searcher: TokenSearch, templates: dict[str, str] = TEMPLATES, rounds: int = ROUNDS) -> DataFrame:
    """Labels with snomed_ct chosen among offered concepts, in at most ``rounds`` rounds; terms are not tried twice.

    The first search is limited to the label's semantic tag, later ones are not.
    An id that was not offered is no choice.
    """
    from kappaforge.functions.texts import semantic_tag

    key = ["episode_id", "label_idx"]
    state = labels.select(*key, "text", "context", F.col("text").alias("term"), semantic_tag(F.col("qualifier")).alias("tag"), F.array(F.lower(F.trim("text"))).alias("tried"))
    solved = None
    for turn in range(rounds):
        found = searcher.search(state.select("term", "tag")).withColumnsRenamed({"term": "_term", "tag": "_tag"})
        offered = state.join(found, (F.col("term") == F.col("_term")) & F.col("tag").eqNullSafe(F.col("_tag"))).drop("_term", "_tag")
        options = F.array_join(F.transform("items", lambda i: F.concat(F.lit("- ID: "), i["id"], F.lit(", Term: "), i["term"])), "\n")
        prompt = F.when(F.size(F.coalesce("items", F.array())) > 0, filled(templates["choose"], text=F.col("term"), context=F.col("context"), options=options)).otherwise(filled(templates["refine"], text=F.col("term"), context=F.col("context")))
        ready = offered.withColumn("prompt", prompt).withColumn("call", F.lit(100 + turn))
        asked = kept(client.reply(ready).withColumn("reply", F.trim(F.coalesce("reply", F.lit("")))))
        chosen = asked.where(F.exists("items", lambda i: i["id"] == F.col("reply"))).select(*key, F.col("reply").alias("_concept"))
        solved = chosen if solved is None else solved.unionByName(chosen)
        if turn + 1 == rounds:
            break
        wish = F.when(F.size(F.coalesce("items", F.array())) > 0, F.regexp_extract("reply", r"(?i)^\s*SEARCH:\s*(.+)$", 1)).otherwise(F.col("reply"))
        term = F.trim(F.regexp_replace(wish, '^[\\s"]+|[\\s"]+$', ""))
        state = asked.withColumn("new", term).where((F.col("new") != "") & ~F.array_contains("tried", F.lower("new")) & ~F.col("new").rlike("^[0-9]+$"))
        state = state.select(*key, "text", "context", F.col("new").alias("term"), F.lit(None).cast("string").alias("tag"), F.array_append("tried", F.lower("new")).alias("tried"))
        if not state.take(1):
            break
    return labels.join(solved, key, "left").withColumn("snomed_ct", F.col("_concept")).drop("_concept")


def scope(stage1: DataFrame, bundles: DataFrame, client: Client, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Stage 2: the principal and secondary rows a model picks from stage 1, which keep their codes."""
    rows = stage1.withColumn("idx", F.col("label_idx"))
    line = candidate_line(F.col("idx"), F.coalesce("qualifier", F.lit("None")), F.coalesce("text", F.lit("None")), code_for(F.col("qualifier"), F.col("icd10"), F.col("opcs4")))
    listed = rows.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("x"))
    prompts = listed.join(bundles, "episode_id").select("episode_id", F.lit(200).alias("call"), filled(templates["scope"], candidates=F.array_join(F.transform("x", lambda i: i["line"]), "\n"), notes=numbered_notes(F.col("notes"))).alias("prompt"))
    selected = client.reply(prompts).select("episode_id", lab.parse_selection("reply").alias("selection"))
    return resolve_selection(rows, lab.picks(selected)).drop("category")


def annotate(bundles: DataFrame, client: Client, searcher: TokenSearch, targets: DataFrame, templates: dict[str, str] = TEMPLATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stage 1, stage 2, calls) of all bundles."""
    labels, calls = extract(bundles, client, templates)
    stage1 = kept(classified(ground(labels, client, searcher, templates), targets))
    return stage1, scope(stage1, bundles, client, templates), calls


def envelopes(stage: DataFrame, episodes: DataFrame, name: str) -> DataFrame:
    """(episode_id, stage, body): one JSON document per episode, also for episodes without labels; missing values as null."""
    fields = [c for c in stage.columns if c != "episode_id"]
    rows = stage.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("label_idx", *(c for c in fields if c != "label_idx")))).alias("labels"))
    out = episodes.select("episode_id").join(rows, "episode_id", "left").withColumn("stage", F.lit(name))
    empty = F.coalesce("labels", F.array())
    return out.select("episode_id", "stage", F.to_json(F.struct("episode_id", "stage", empty.alias("labels")), {"ignoreNullFields": "false"}).alias("body"))
