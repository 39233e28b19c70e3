"""Texts of notes, labels and prompts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE_LENGTH, MIN_PROBE = 60, 12


def canon(text: Column) -> Column:
    """Lower case, white space collapsed, then every other character but a-z and 0-9 a space; trimmed."""
    t = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9 ]", " "))


def probe(text: Column) -> Column:
    """First characters of a canonical snippet; null for snippets too short to tell."""
    return F.when(F.length(text) >= MIN_PROBE, F.substring(text, 1, PROBE_LENGTH))


def semantic_tag(qualifier: Column) -> Column:
    q = F.lower(qualifier)
    return F.when(q.contains("diagnos"), "disorder").when(q.contains("procedure"), "procedure")


def numbered_notes(notes: Column) -> Column:
    """Notes (array of structs note_date, note_class, text) under numbered headers; which is the anchor is not told."""
    block = lambda n, i: F.concat(F.lit("--- Note "), (i + 1).cast("string"), F.lit(" | "), n["note_date"].cast("string"), F.lit(" | "), n["note_class"], F.lit(" ---\n"), n["text"])
    return F.array_join(F.transform(notes, block), "\n\n")


def candidate_line(position: Column, qualifier: Column, text: Column, code: Column) -> Column:
    """One line of a scoping prompt."""
    end = F.when(code.isNull() | (F.lower(code) == "nan"), "").otherwise(F.concat(F.lit(" | "), code))
    return F.concat(F.lit("  ["), position.cast("string"), F.lit("] "), qualifier, F.lit(" | "), F.substring(text, 1, 80), end)


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Estimated price of a run at prices per million tokens."""
    return F.bround(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out, 6)


def filled(template: str, **columns: Column) -> Column:
    """A prompt from a template with {name} places; templates are configuration."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out
