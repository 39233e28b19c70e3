"""Notes: anchors by snippet containment, nearest coder date, windows and bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaforge.functions.codes import episode_id
from kappaforge.functions.texts import canon, probe
from kappaforge.operators.asof import around
from kappaforge.operators.containment import contained
from kappaforge.sources.scratch import kept

PRE_DAYS, POST_DAYS, SUSPECT_DAYS = 90, 30, 45


def anchors(notes: DataFrame, snippets: DataFrame, coder_dates: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(episode, note_id, note_date, matched, tried, gap): the note with most snippets of every episode.

    ``notes`` has note_id, note_date, note_text; ``snippets`` has episode and
    snippet (repeats count); ``coder_dates`` has episode and adm. ``on`` names
    columns that notes and snippets share, such as person_id; a note and a snippet
    then meet only within them. One pass over the notes finds the probes that each
    contains, and only these are joined. Ties go to the smallest gap to a coder
    date, then the date, then the note_id.
    """
    probes = snippets.withColumn("probe", probe(canon(F.col("snippet")))).where("probe is not null")
    tried = probes.groupBy("episode").agg(F.count("*").alias("tried"))
    asked = probes.groupBy("episode", "probe", *(on or [])).agg(F.count("*").alias("n"))
    texts = notes.select("note_id", "note_date", *(on or []), canon(F.col("note_text")).alias("canon"))
    pairs = contained(texts, "canon", asked).join(asked, ["probe", *(on or [])])
    hits = kept(pairs.groupBy("episode", "note_id", "note_date").agg(F.sum("n").alias("matched")))
    most = hits.groupBy("episode").agg(F.max("matched").alias("matched"))
    best = hits.join(most, ["episode", "matched"])
    near = around(best, coder_dates, ["episode"], "note_date", "adm")
    gap = F.least(F.datediff("note_date", "before"), F.datediff("after", "note_date"))
    ranked = best.join(near.select("episode", "note_date", gap.alias("gap")), ["episode", "note_date"], "left")
    first = F.min(F.struct(F.coalesce("gap", F.lit(2**31 - 1)).alias("g"), "note_date", "note_id", "gap", "matched"))
    out = ranked.groupBy("episode").agg(first.alias("b")).join(tried, "episode")
    return out.select("episode", "b.note_id", "b.note_date", "b.matched", "tried", "b.gap")


def windows(anchored: DataFrame, notes: DataFrame, on: list[str] | None = None, pre: int = PRE_DAYS, post: int = POST_DAYS) -> DataFrame:
    """(episode, note_id, is_anchor, ...): notes of the days around each anchor, and the anchor itself.

    Without a shared key the range join is bucketed by blocks of days as wide
    as the window, so that each note meets the anchors of two blocks only.
    """
    width = pre + post + 1
    low, high = F.date_sub("anchor_date", pre), F.date_add("anchor_date", post)
    a = anchored.select("episode", *(on or []), F.col("note_id").alias("anchor_id"), F.col("note_date").alias("anchor_date"))
    block = lambda d: F.floor(F.unix_date(d) / width)
    a = a.withColumn("_block", F.explode(F.array_distinct(F.array(block(low), block(high)))))
    rows = a.join(notes.dropDuplicates(["note_id"]).withColumn("_block", block(F.col("note_date"))), ["_block", *(on or [])])
    return rows.where(F.col("note_date").between(low, high)).withColumn("is_anchor", F.col("note_id") == F.col("anchor_id")).drop("_block")


def suspect(gap: str = "gap", days: int = SUSPECT_DAYS):
    """True where the anchor is far from any coder date, or there is none."""
    return F.col(gap).isNull() | (F.col(gap) > days)


def bundles(anchored: DataFrame, window: DataFrame, raw_id: str = "episode", pre: int = PRE_DAYS, post: int = POST_DAYS, note: Column | None = None) -> DataFrame:
    """One nested document per episode, notes by date and id.

    ``note`` is what a document holds of a note, the whole note without it: with
    something short, no text is gathered. Notes are sorted by day first, so that
    only lists of days meet in an episode.
    """
    if note is None:
        note = F.struct("note_date", "note_id", "note_class", "is_anchor", F.coalesce("note_text", F.lit("")).alias("text"))
    rows = window.select("episode", "note_date", "note_id", note.alias("note"))
    days = rows.groupBy("episode", "note_date").agg(F.transform(F.array_sort(F.collect_list(F.struct("note_id", "note"))), lambda x: x["note"]).alias("notes"))
    notes = days.groupBy("episode").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("note_date", "notes"))), lambda x: x["notes"])).alias("notes"))
    out = anchored.join(notes, "episode")
    day = F.col("note_date")
    return out.select(
        F.col("episode"), episode_id(F.col(raw_id), day).alias("episode_id"), F.col("note_id").alias("anchor_note_id"), day.alias("anchor_date"), F.array("matched", "tried").alias("anchor_snippets_matched"),
        F.col("gap").alias("coder_gap_days"), suspect().alias("anchor_suspect"), F.array(F.date_sub(day, pre).cast("string"), F.date_add(day, post).cast("string")).alias("window"), F.size("notes").alias("n_notes"), "notes",
    )
