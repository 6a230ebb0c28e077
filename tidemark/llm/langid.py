"""Language by compression: the language whose dictionary makes the text smallest.

Letters are kept, everything else becomes a space, so that symbols and shouting say nothing.  A text is compressed in
short pieces, for in a long one its own words would take the dictionary's place; the sizes add up over the whole text.
Sizes are whole bytes, which is coarse for a short text: one that fits in a piece is also compressed turned round at a
few words, and the sizes are added.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, map_texts

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the learned dictionaries and of the verdict.

    A dictionary holds at most ``dictionary_bytes`` of a language, shared out evenly over at most ``dictionary_rows``
    learning rows and at most ``excerpt_chars`` of each; ``margin`` is the least relative gain over the second best language.
    """

    dictionary_bytes: int = 128 * 1024
    dictionary_rows: int = 512
    excerpt_chars: int = 1024
    piece_bytes: int = 1024
    level: int = 5
    turns: int = 3
    margin: float = 0.002


def letters(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def excerpt(text: str, chars: int) -> str:
    """So many letters of a text, from the word at a position that its hash chooses; a short text whole."""
    if len(text) <= chars:
        return text
    start = zlib.crc32(text.encode("utf-8", "replace")) % (len(text) - chars + 1)
    start = text.rfind(" ", 0, start) + 1 if start else 0
    return text[start:start + chars]


def dictionaries(learn: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """Raw dictionary content by language, from rows (doc_id, text, lang).

    The rows are those with the least hash of the text, so any partitioning gives the same ones; copies count once.
    Every language that occurs is learned; the driver holds at most ``dictionary_rows`` excerpts of each.  An excerpt
    starts at a word of the whole text that its hash chooses.
    """
    rows = learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    # Hashes are uniform: twice the wanted share of a language's texts holds the least ones, and only those are sorted.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"))
    share = F.lit(2 * settings.dictionary_rows + 256) / F.col("texts")
    low = rows.select("lang", "h").join(counts, "lang").where(F.col("h") / F.lit(2.0 ** 64) + 0.5 <= share)
    least = Window.partitionBy("lang").orderBy("h")
    chosen = low.groupBy("lang", "h").agg(F.lit(0)).withColumn("at", F.row_number().over(least)).where(F.col("at") <= settings.dictionary_rows).select("lang", "h")
    some = (
        rows.join(F.broadcast(chosen), ["lang", "h"])  # at most dictionary_rows texts of a language
        .select(F.struct("lang", "h").alias("doc_id"), "text")
    )

    def make():
        return lambda texts: ((excerpt(letters(t), settings.excerpt_chars),) for t in texts)

    cut = map_texts(some, "excerpt string", make).groupBy("doc_id").agg(F.min("excerpt").alias("excerpt"))
    excerpts: dict[str, list[str]] = {}
    for r in cut.select("doc_id.lang", "excerpt").orderBy("doc_id.lang", "doc_id.h").collect():
        excerpts.setdefault(r["lang"], []).append(r["excerpt"])
    found = {}
    for name in sorted(excerpts):
        some = [e.encode("utf-8", "replace") for e in excerpts[name] if e]
        share = settings.dictionary_bytes // max(1, len(some)) - 1
        found[name] = b" ".join(e[:share] for e in some)
    return {name: content for name, content in found.items() if content}


class Classifier:
    """Sizes of a text under each dictionary."""

    def __init__(self, contents: dict[str, bytes], settings: Settings):
        self.settings, self.names = settings, sorted(contents)
        self.coders = []
        for name in self.names:
            dictionary = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=settings.level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=dictionary, level=settings.level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data, step = letters(text).encode("utf-8", "replace"), self.settings.piece_bytes
        pieces = [data[k:k + step] for k in range(0, len(data), step)]
        if len(pieces) == 1:
            words, parts = data.split(), self.settings.turns + 1
            cuts = (len(words) * k // parts for k in range(1, parts))
            pieces += [b" ".join(words[c:] + words[:c]) for c in cuts if c]
        return [sum(len(coder.compress(p)) for p in pieces) for coder in self.coders]

    def verdict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, confidence, relative margin and whether the margin is wide enough."""
        if not text or not self.names or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], self.names[k]))
        weights = [2.0 ** -min(60.0, 0.5 * (s - sizes[best])) for s in sizes]
        second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / max(1, second)
        return self.names[best], 1.0 / sum(weights), margin, margin >= self.settings.margin


def identify(docs: DataFrame, contents: dict[str, bytes], settings: Settings = Settings(), whole: bool = False) -> DataFrame:
    """doc_id (or row), lang_pred, score, margin, accepted of every whole text.

    A null text or one without a letter is ``und``, score 0, not accepted; so is every text if no language was
    learned.  Ties go to the language first in the alphabet and are not accepted.  Repeated rows each get their row.
    """
    def make():
        judge = Classifier(contents, settings)
        return lambda texts: map(judge.verdict, texts)

    return map_texts(docs, "lang_pred string, score double, margin double, accepted boolean", make, whole)


def identify_all(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``identify`` with held_out, learned from the rows of ``docs`` that are not held out."""
    out = held_out(F.col("doc_id"), 4, 2)
    contents = dictionaries(docs.where(~out).select("doc_id", "text", "lang"), settings)
    return identify(docs, contents, settings).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")
