"""Organisations and patents that texts name, for searches for experts and patents.

Mentions come from a map over texts; what belongs together is found by grouping their keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: legal forms, words that a named body begins with, and the kinds that they make
LEGAL_FORMS = ("ООО", "АО", "ОАО", "ПАО", "ФГУП", "ФГБУ", "ФИЦ", "НИЦ")
BODIES = (r"[Ии]нститут", r"[Лл]аборатория", r"Исследовательский\s+центр", r"Научный\s+центр")
KINDS = (("laboratory", ("лаборатор",)), ("institute", ("институт", "внии", "цнигри", "гипроникель", "иргиредмет")), ("research_center", ("ниц", "научный центр", "исследовательский центр")))
# fixed values: what a mention must not hold, and cues that an organisation is at work
REJECTED = ("заключение по", "исследования по", "рисунок ", "таблица ", "источник ", "ист.:", "ключевые слова", "студенты", "отлично справ", "создана на базе", "создано на базе", "для подготовки")
ACTIVITY = ("исслед", "разработ", "заним", "провод", "выполн", "испыт", "изуч", "технолог", "проект", "автор", "сотрудник", "специалист")
# fixed values: characters around a mention that are searched for the topic and for activity; least and most letters of a name
TOPIC_REACH, ACTIVITY_REACH, SHORTEST, LONGEST = 650, 420, 4, 110

_FORMS = "|".join(LEGAL_FORMS)
_PROPER = r"[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё-]{2,35}"
_QUOTED = r"«[^»\n]{2,%d}»|\"[^\"\n]{2,%d}\""
_NAMED = rf"(?:{_QUOTED % (80, 80)}|{_PROPER}(?:\s+{_PROPER}){{0,4}}|[A-ZА-ЯЁ]{{3,20}})"
_MENTIONS = [re.compile(rf"\b(?:{_FORMS})\s+(?:{_QUOTED % (90, 90)}|[A-ZА-ЯЁ0-9][\w.-]{{2,50}})", re.IGNORECASE), *(re.compile(rf"\b(?:{body})\s+{_NAMED}") for body in BODIES)]
_FORM = re.compile(rf"\b(?:{_FORMS})\b", re.IGNORECASE)
_LEADING_FORM = re.compile(r"^\s*(?:ооо|ао|оао|пао|фгуп|фгбу|фиц)\s+")
_NAMED_TAIL = re.compile(rf"[«\"]|[A-ZА-ЯЁ]{{3,20}}\b|{_PROPER}\b")


def display_name(name: str) -> str:
    """A mention without soft hyphens, control signs, spare spaces and signs at its ends."""
    shown = " ".join(re.sub(r"[\x00-\x1f\x7f]", " ", name.replace("­", "")).split()).strip(" ,.;:")
    return shown[:-1].rstrip() if shown.endswith("»") and "«" not in shown else shown


def entity_key(name: str) -> str:
    """A name for comparison that bears scanning errors: letters and digits alone, without a leading legal form."""
    return re.sub(r"[^a-zа-яё0-9]+", "", _LEADING_FORM.sub("", display_name(name).casefold()))


def quality(name: str) -> tuple[int, int, int, int]:
    """How bad a name is for display: open quotes, words beyond five, short words, letters beyond ninety."""
    shown = display_name(name)
    inner = re.search(r"«([^»]+)»", shown)
    words = re.findall(r"[A-Za-zА-Яа-яЁё]+", inner[1] if inner else shown)
    forms = {form.casefold() for form in LEGAL_FORMS}
    short = sum(1 < len(w) <= 4 and w.casefold() not in forms for w in words)
    return abs(shown.count("«") - shown.count("»")), max(0, len(words) - 5), short, max(0, len(shown) - 90)


def plausible(name: str) -> bool:
    """Whether a cleaned mention is a name: its length, no telltale phrase, one legal form at most, a named laboratory."""
    lower = name.casefold()
    if not SHORTEST <= len(name) <= LONGEST or any(mark in lower for mark in REJECTED) or len(_FORM.findall(name)) > 1:
        return False
    if lower.startswith("лаборатория ") and not _NAMED_TAIL.match(name[len("лаборатория ") :].strip()):
        return False
    return bool(entity_key(name))


def kind_of(name: str) -> str:
    return next((kind for kind, cues in KINDS if any(cue in name.lower() for cue in cues)), "organization")


class Mention(NamedTuple):
    name: str
    kind: str
    start: int
    end: int


def mentions(text: str) -> Iterator[Mention]:
    """Plausible organisations of a text and where they stand; plain ones must be at work nearby."""
    for found in (m for pattern in _MENTIONS for m in pattern.finditer(text)):
        name = display_name(found[0])
        if not plausible(name):
            continue
        kind = kind_of(name)
        if kind != "organization" or any(cue in near(text, found.start(), found.end(), ACTIVITY_REACH) for cue in ACTIVITY):
            yield Mention(name, kind, found.start(), found.end())


def near(text: str, start: int, end: int, reach: int) -> str:
    return text[max(0, start - reach) : end + reach].casefold()


def expert_mentions(texts: DataFrame, stems: Sequence[str] = (), chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """Plausible organisations near a topic: chunk_id, key, name, kind, topic_hits, quality (array).

    With stems, one must stand within reach of the mention; long stems count as hits.  Null texts mention none.
    """
    dtype = texts.schema[chunk_id].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in batch.itertuples(index=False):
                for m in mentions(text):
                    found = [s for s in stems if s in near(text, m.start, m.end, TOPIC_REACH)]
                    if found or not stems:
                        hits = max(1, sum(len(s) >= 7 for s in found)) if stems else 0
                        rows.append((key, entity_key(m.name), m.name, m.kind, hits, list(quality(m.name))))
            yield pd.DataFrame(rows, columns=["chunk_id", "key", "name", "kind", "topic_hits", "quality"])

    source = texts.select(F.col(chunk_id).alias("chunk_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    return source.mapInPandas(find, f"chunk_id {dtype}, key string, name string, kind string, topic_hits int, quality array<int>")


def ranked_experts(mentions: DataFrame, limit: int | None = 20) -> DataFrame:
    """Organisations by key: the best name with its kind, most topic hits, evidence (how many chunks), the best first.

    Order: topic hits and evidence, descending, then the name's quality and the name.  Without a limit all, in no order.
    """
    best = F.min(F.struct("quality", "name", "kind")).alias("best")
    grouped = mentions.groupBy("key").agg(best, F.max("topic_hits").alias("topic_hits"), F.count_distinct("chunk_id").alias("evidence"))
    named = grouped.select("key", "best.name", "best.kind", "topic_hits", "evidence", F.col("best.quality").alias("quality"))
    return named if limit is None else named.orderBy(F.desc("topic_hits"), F.desc("evidence"), "quality", F.lower("name"), "key").limit(limit)


# fixed values: offices and how patents are written
PATENT_NUMBER = r"(?iu)\bпатент(?:е|а|у|ом|ы|ов)?\s+(?:(?:США|РФ|России|US|RU|EP|WO|CN|JP)\s*)?(?:№|N|No\.?)?\s*\d{5,}\b"
PATENT_CODE = r"(?iu)\b(?:WO|EP|US|RU|SU|CN|JP)[/\-\s]?\d{4,}(?:[/\-]\d{3,})+\b"
PATENT_SIGNAL = r"(?iu)\b(?:патент\w*|запатент\w*|изобретен\w*|patent\w*)\b"


def has_patent(text: Column | str) -> Column:
    return F.regexp(text, F.lit(PATENT_NUMBER)) | F.regexp(text, F.lit(PATENT_CODE))


def has_patent_signal(text: Column | str) -> Column:
    return F.regexp(text, F.lit(PATENT_SIGNAL))


def patents(texts: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """Patents that texts name, once each: key, identifier and chunk_id of the first mention, mentions (chunks)."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (PATENT_NUMBER, PATENT_CODE)))
    each = texts.select(F.col(chunk_id).alias("chunk_id"), F.explode(found).alias("raw")).withColumn("identifier", F.trim(F.col("raw"), F.lit(" ,.;:")))
    keyed = each.withColumn("key", F.regexp_replace(F.lower("identifier"), r"\s+", " "))
    first = F.min(F.struct("chunk_id", "identifier")).alias("first")
    return keyed.groupBy("key").agg(first, F.count_distinct("chunk_id").alias("mentions")).select("key", "first.identifier", "first.chunk_id", "mentions")
