"""Quality rules on words, lines and on how public vocabularies split the text.

Base counts come from words between ASCII white space.  The verdict adds tokeniser fertility: two public vocabularies,
one of pieces with byte fallback and one of byte pairs, measure characters per token, the share of tokens that are a lone
byte of a longer character and the entropy of the tokens against the most that so many could have.  Each measure is
held to a band that is learned from the whole table, by language, script and length, since all three move it: the median
and a number of spreads, the spread taken from the quartiles so that junk hardly widens it.  A text of any length is
judged; where too few texts are alike for a band of their own, the band of the script or a fixed one takes its place.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts
from tidemark.llm.pieces import model_bytes
from tidemark.session import stage

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SCRIPTS = (
    ("latin", re.compile(r"[A-Za-zÀ-ɏ]")),
    ("cyrillic", re.compile(r"[Ѐ-ӿ]")),
    ("greek", re.compile(r"[Ͱ-Ͽ]")),
    ("arabic", re.compile(r"[؀-ۿ]")),
    ("cjk", re.compile(r"[぀-ヿ一-鿿가-힯]")),
)


@dataclass(frozen=True)
class Rules:
    """``spreads`` are standard deviations, estimated from the quartiles, between the median and either end of a band.

    A group of texts needs ``least_rows`` of them for a band of its own.  ``floors`` are the least spreads: of characters
    per token as a share of the median, of the byte share and of the entropy.  ``fixed`` is (least and most characters
    per token, most byte share, least entropy) for scripts of few texts.
    """

    least_words: int = 10
    most_repeat_percent: int = 20
    window: int = 5
    spreads: float = 6.0
    least_rows: int = 200
    floors: tuple[float, float, float] = (0.01, 0.005, 0.005)
    fixed: dict[str, tuple[float, float, float, float]] = field(default_factory=lambda: {
        "latin": (1.2, 8.0, 0.25, 0.2), "cyrillic": (0.6, 8.0, 0.60, 0.2), "greek": (0.4, 6.0, 0.90, 0.2), "arabic": (0.4, 6.0, 0.90, 0.2),
        "cjk": (0.2, 4.0, 0.90, 0.2), "mixed": (1.3, 8.0, 0.25, 0.2), "other": (0.2, 8.0, 0.95, 0.1)})


VOCABULARIES = ("pieces", "pairs")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
ALIKE = ("script", "language", "size")


def repeated_words(words: list, window: int = 5) -> int:
    """Words that lie in a window of so many words that occurs at least twice, its first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = dict.fromkeys(words)
    number = dict(zip(number, range(len(number))))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    code, span = ids[:n], len(number)
    for k in range(1, window):  # a window's number, from that of the window one word shorter and the word
        if span * len(number) >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            span = n
        code, span = code * len(number) + ids[k:n + k], span * len(number)
    order = np.argsort(code, kind="stable")
    same = np.diff(code[order]) == 0
    if not same.any():
        return 0
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """Code points in words, symbols, repeated lines that hold a word, words of repeated windows."""
    lines = [x for x in text.split("\n") if x.encode("utf-8", "replace").split()] if "\n" in text else []
    chars = len(text) - sum(map(text.count, " \t\n\r\v\f"))
    return chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def script_of(text: str) -> str:
    """The script with most letters, ties to the first listed; mixed if it has under three quarters of them."""
    if text.isascii():
        return "latin" if _SCRIPTS[0][1].search(text) else "other"
    counts = [(len(p.findall(text)), name) for name, p in _SCRIPTS]
    most = max(c for c, _ in counts)
    if 4 * most < 3 * sum(c for c, _ in counts):
        return "mixed"
    return next(name for c, name in counts if c == most) if most else "other"


def token_measures(ids: np.ndarray, n_chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, share of lone bytes, entropy as a share of the most for so many tokens; zeros for none."""
    if not len(ids):
        return 0.0, 0.0, 0.0
    order = np.sort(ids)
    ends = np.flatnonzero(order[1:] != order[:-1])
    seen = np.diff(ends, prepend=-1, append=len(ids) - 1)
    most = np.log2(len(ids))
    entropy = most - (seen * np.log2(seen)).sum() / len(ids)
    return n_chars / len(ids), float(np.count_nonzero(is_byte[ids])) / len(ids), float(entropy / most) if most else 0.0


def pair_ranks(path: str | None = None) -> dict[bytes, int]:
    """The byte-pair vocabulary's content; it travels with the task, so workers need no file."""
    import public_tokenizers
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Coders:
    """Token ids of texts in both vocabularies, and which ids are a lone byte of a longer character."""

    def __init__(self, proto: bytes, ranks: dict[bytes, int], pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pairs = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        newline = self.pieces.piece_to_id("<0x0A>")  # line ends are bytes in any script
        lone = np.array([self.pieces.is_byte(i) and i != newline for i in range(self.pieces.get_piece_size())])
        part = np.zeros(max(ranks.values()) + 1, bool)
        part[[rank for token, rank in ranks.items() if len(token) == 1 and token[0] >= 128]] = True
        self.lone = lone, part

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.pieces.encode(text), np.int32), np.array(self.pairs.encode_ordinary(text), np.int32)


def measured(df: DataFrame, rules: Rules = Rules(), model: str | None = None, pairs: str | None = None) -> DataFrame:
    """doc_id, language, base counts, base_failed, script, size and the measures of both vocabularies of every whole text.

    ``size`` is the number of binary digits of the number of pieces.
    """
    import public_tokenizers
    proto, ranks, pattern = model_bytes(model), pair_ranks(pairs), public_tokenizers.PATTERN

    def make():
        both = Coders(proto, ranks, pattern)

        def one(text):
            data = (text or "").encode("utf-8", "replace")
            text, words = data.decode("utf-8"), data.split()
            chars, symbols, lines, again = base_counts(text, words)
            failed = len(words) < rules.least_words or 100 * again > rules.most_repeat_percent * len(words)
            ids = both(text)
            out = [x for some, lone in zip(ids, both.lone) for x in (len(some), *token_measures(some, len(text), lone))]
            return len(words), chars, symbols, lines, again, failed, script_of(text), len(ids[0]).bit_length(), *out
        return lambda texts: map(one, texts)

    columns = ", ".join(f"{v}_tokens long, " + ", ".join(f"{v}_{m} double" for m in MEASURES) for v in VOCABULARIES)
    language = F.coalesce("lang", F.lit("")) if "lang" in df.columns else F.lit("")
    named = df.select(F.struct("doc_id", language.alias("language")).alias("doc_id"), "text")
    base = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, size int"
    found = map_texts(named, f"{base}, {columns}", make)
    return found.select("doc_id.doc_id", "doc_id.language", *[c for c in found.columns if c != "doc_id"])


def bands(rows: DataFrame, by: tuple[str, ...], rules: Rules) -> DataFrame:
    """``by`` and, for each measure, low_ and high_ ends from the texts that pass the base rules, if there are enough.

    The quartiles come from Spark's mergeable sketch, so no group is collected.
    """
    every = [f"{v}_{m}" for v in VOCABULARIES for m in MEASURES]
    quartiles = rows.where(~F.col("base_failed")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("alike"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in every])
    ends = {}
    for v in VOCABULARIES:
        for m, least in zip(MEASURES, rules.floors):
            q = F.col(f"{v}_{m}")
            floor = least * q[1] if m == "chars_per_token" else F.lit(least)
            reach = rules.spreads * F.greatest((q[2] - q[0]) / 1.349, floor)
            ends |= {f"low_{v}_{m}": q[1] - reach, f"high_{v}_{m}": q[1] + reach}
    return quartiles.where(F.col("alike") >= rules.least_rows).select(*by, *[c.alias(n) for n, c in ends.items()])


def _fits(low: Callable[[str], Column], high: Callable[[str], Column]) -> Column:
    """Whether all measures lie in their bands; a small byte share and a great entropy are never wrong."""
    parts = []
    for v in VOCABULARIES:
        per, share, entropy = (f"{v}_{m}" for m in MEASURES)
        parts.append(F.col(per).between(low(per), high(per)) & (F.col(share) <= high(share)) & (F.col(entropy) >= low(entropy)))
    return parts[0] & parts[1]


def quality(df: DataFrame, rules: Rules = Rules(), model: str | None = None, pairs: str | None = None) -> DataFrame:
    """doc_id, counts, base_failed, kept, band, script, size and measures of every whole text.

    ``band`` says which band judged the text: that of texts ``alike``, of its ``script`` or a ``fixed`` one.  A null text
    counts as empty: no words, base_failed, not kept.  A null language is one of its own.  Repeated rows each get their
    row; an empty table gives none; other columns play no part.
    """
    rows = stage(measured(df, rules, model, pairs))
    own = bands(rows, ALIKE, rules)
    wide = bands(rows, ("script",), rules)
    names = [c for c in wide.columns if c != "script"]
    joined = rows.join(own.select(*ALIKE, F.struct(*names).alias("own")), list(ALIKE), "left").join(wide.select("script", F.struct(*names).alias("wide")), "script", "left")
    fixed = F.create_map(*[x for s, b in rules.fixed.items() for x in (F.lit(s), F.array(*map(F.lit, b)))])[F.col("script")]

    def fixed_low(name: str) -> Column:
        return fixed[0] if name.endswith(MEASURES[0]) else fixed[3]

    def fixed_high(name: str) -> Column:
        return fixed[1] if name.endswith(MEASURES[0]) else fixed[2]
    band = F.when(F.col("own").isNotNull(), "alike").when(F.col("wide").isNotNull(), "script").otherwise("fixed")
    fits = (F.when(F.col("own").isNotNull(), _fits(lambda n: F.col(f"own.low_{n}"), lambda n: F.col(f"own.high_{n}")))
            .when(F.col("wide").isNotNull(), _fits(lambda n: F.col(f"wide.low_{n}"), lambda n: F.col(f"wide.high_{n}"))).otherwise(_fits(fixed_low, fixed_high)))
    judged = joined.withColumns({"kept": ~F.col("base_failed") & fits, "band": band})
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band"]
    return judged.select(*first, *[c for c in rows.columns if c not in first])
