"""Quality rules: repetition counts, and how well public vocabularies fit a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondcart.llm.common import (
    codes,
    exact_columns,
    joined,
    offsets_of,
    per_process,
    ragged,
    sums,
    text_slices,
    words,
)

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Accepted values of one language or script; what lies outside is rejected.

    ``low`` and ``high`` bound the characters per token, ``bytes`` the share of tokens that stand
    for single bytes, ``entropy`` is the least entropy of the tokens as a share of the most that
    as many tokens could have, ``second`` the least characters per token of a second vocabulary.
    """

    low: float
    high: float
    bytes: float
    entropy: float
    second: float = 0.0


# Bands per language code, then per script for other or missing codes. Prose of a Latin language
# has some 4 characters a token, made-up words of its syllables nearly 2; words of random letters
# have 1.55 in lower and 1.35 in upper case, random letters and digits and base64 1.2, runs of
# punctuation 1.25 and of digits 0.9. The lower bounds lie between. Runs of one token fall to the
# entropy, scripts that a vocabulary does not know to the share of bytes, and a text without any
# letter is judged as "other".
LATIN = Band(low=1.6, high=9.0, bytes=0.10, entropy=0.30, second=1.3)
GERMANIC = Band(low=1.65, high=9.0, bytes=0.10, entropy=0.30, second=1.3)
BANDS = {
    **dict.fromkeys("en de nl".split(), GERMANIC),
    **dict.fromkeys("fr es it pt".split(), LATIN),
    "latin": LATIN,
    "greek": Band(0.6, 6.0, 0.20, 0.30),
    "cyrillic": Band(1.0, 8.0, 0.20, 0.30),
    "semitic": Band(0.6, 6.0, 0.30, 0.30),
    "indic": Band(0.2, 6.0, 0.95, 0.20),
    "cjk": Band(0.2, 4.0, 0.95, 0.20),
    "other": Band(1.4, 9.0, 0.95, 0.10),
}
SCRIPTS = ("other", "latin", "greek", "cyrillic", "semitic", "indic", "cjk")


def _script_table() -> np.ndarray:
    """Script by a character's first UTF-8 byte; 0 for what tells nothing."""
    table = np.zeros(256, np.uint8)
    for script, ranges in {
        1: ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)),
        2: ((0xCE, 0xCF),),
        3: ((0xD0, 0xD4),),
        4: ((0xD6, 0xDD),),
        5: ((0xE0, 0xE1),),
        6: ((0xE3, 0xED),),
    }.items():
        for a, b in ranges:
            table[a : b + 1] = script
    return table


SCRIPT_OF_BYTE = _script_table()


class Vocabulary:
    """A sentencepiece model: the tokens of single words, and which tokens are bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(len(self.model))])

    def encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.model.encode(some, num_threads=1)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))
        return flat, sizes


class ByteVocabulary:
    """Ranks of a byte-level vocabulary: how many tokens a word has, after a blank."""

    def __init__(self, path: str, pattern: str):
        import base64

        from tiktoken import Encoding

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def sizes(self, some: list[str]) -> np.ndarray:
        encode = self.model.encode_ordinary
        return np.fromiter((len(encode(" " + w)) for w in some), np.int64, len(some))


def _owner(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def repeated_words(index: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Per text, the words inside any window that occurs twice or more in that text."""
    n = len(index)
    if n < window:
        return np.zeros(len(offsets) - 1, np.int64)
    owner = _owner(offsets)
    key = owner[: n - window + 1].astype(np.int64)
    whole = owner[: n - window + 1] == owner[window - 1 :]
    base = int(index.max()) + 1
    # One word at a time: (what came before, next word) becomes a number below n again, so that
    # windows are compared exactly, not by hashes.
    for k in range(window):
        key = pd.factorize(key * base + index[k : n - window + 1 + k])[0].astype(np.int64)
    key = key[whole]
    twice = np.bincount(key)[key] > 1
    at = np.flatnonzero(whole)[twice]
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[at + k] = True
    return sums(covered, offsets)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    with_word = ~blank.to_numpy(zero_copy_only=False)
    index = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    pairs = pd.Series(_owner(offsets) * (len(lines) + 1) + index)
    again = pairs.duplicated().to_numpy() & with_word
    return sums(again, offsets)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    raw = pc.binary_join(whole, "")[0].as_buffer()
    return np.frombuffer(raw, np.uint8), offsets_of(lengths)


def measure(
    texts: pa.Array, vocabulary: str, second: tuple[str, str] | None = None
) -> dict[str, np.ndarray]:
    """All measures of every text (NULL counts as empty).

    ``second`` is the file and the split pattern of a byte-level vocabulary. Every distinct word
    is encoded once per batch, so a very long text costs what its different words do.
    """
    texts = pc.fill_null(texts, "")
    flat, offsets = words(texts)
    n_words = np.diff(offsets)
    raw, ends = _bytes_of(texts)
    table = np.zeros(256, bool)
    table[list(SYMBOLS.encode())] = True
    scripts = SCRIPT_OF_BYTE[raw]
    out = {
        "n_words": n_words,
        "word_chars": sums(pc.utf8_length(flat).to_numpy(zero_copy_only=False), offsets),
        "n_symbols": sums(table[raw], ends),
        "n_dup_lines": duplicate_lines(texts),
    }
    there = np.flatnonzero(np.bincount(scripts, minlength=len(SCRIPTS))[1:]) + 1
    out["script"] = np.zeros(len(texts), np.int64)
    if len(there):
        per_script = np.stack([sums(scripts == k, ends) for k in there])
        out["script"] = np.where(per_script.max(0) > 0, there[per_script.argmax(0)], 0)
    if len(flat) == 0:
        zeros = np.zeros(len(texts), np.int64)
        names = ("n_repeat_words", "n_tokens", "n_bytes", "n_second")
        return out | dict.fromkeys(names, zeros) | {
            "entropy": zeros.astype(float)
        }
    distinct, index = codes(flat)
    index = index.astype(np.int64)
    out["n_repeat_words"] = repeated_words(index, offsets, REPEAT_WINDOW)
    model = per_process(f"pieces:{vocabulary}", lambda: Vocabulary(vocabulary))
    some = joined(distinct).split(" ")
    ids, sizes = model.encode(some)
    starts = offsets_of(sizes)[:-1]
    token_offsets = offsets_of(sizes[index])[offsets]
    tokens = ids[ragged(sizes[index], starts[index])]
    out["n_tokens"] = np.diff(token_offsets)
    out["n_bytes"] = sums(model.is_byte[tokens], token_offsets)
    out["entropy"] = token_entropy(tokens, token_offsets, len(model.is_byte))
    out["n_second"] = np.zeros(len(texts), np.int64)
    if second is not None:
        other = per_process(f"bytes:{second[0]}", lambda: ByteVocabulary(*second))
        out["n_second"] = sums(other.sizes(some)[index], offsets)
    return out


def token_entropy(tokens: np.ndarray, offsets: np.ndarray, n_kinds: int) -> np.ndarray:
    """Per text, the entropy of its tokens as a share of the most that as many could have."""
    owner = _owner(offsets)
    code, kinds = pd.factorize(owner * n_kinds + tokens)
    counts = np.bincount(code, minlength=len(kinds)).astype(float)
    parts = np.bincount(kinds // n_kinds, counts * np.log2(counts), len(offsets) - 1)
    n = np.diff(offsets).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        most = np.log2(np.minimum(n, n_kinds))
        share = (np.log2(n) - parts / n) / most
    return np.where(n > 1, share, 0.0)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (
        100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"]
    )


def outside_band(m: dict[str, np.ndarray], langs: list[str | None], bands: dict[str, Band]):
    """Whether a text's fertility lies outside the band of its language or script."""
    picked = [
        bands[lang] if lang in bands and SCRIPTS[s] in ("latin", "other") else bands[SCRIPTS[s]]
        for lang, s in zip(langs, m["script"], strict=True)
    ]
    low, high, most_bytes, entropy, second = np.array(
        [(b.low, b.high, b.bytes, b.entropy, b.second) for b in picked]
    ).reshape(-1, 5).T
    tokens = np.maximum(m["n_tokens"], 1)
    per_token, share = m["word_chars"] / tokens, m["n_bytes"] / tokens
    # Without a second vocabulary no text has tokens of it.
    poor = m["word_chars"] < second * m["n_second"]
    return (
        (per_token < low)
        | (per_token > high)
        | (share > most_bytes)
        | (m["entropy"] < entropy)
        | poor
    )


OUTPUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long,"
    " n_byte_tokens long, token_entropy double, n_second_tokens long"
)


def quality(
    docs: DataFrame,
    vocabulary: str,
    bands: dict[str, Band] | None = None,
    second: tuple[str, str] | None = None,
) -> DataFrame:
    """Measures and verdict of every row, in one pass without a shuffle.

    ``doc_id`` is passed on as it is (NULL and repeated ids too); every row is judged for itself,
    so ties and repeated rows have the same verdict. A NULL or empty text has no words and fails
    the base rule; a very long one is measured whole. A NULL or unknown ``lang`` is judged by the
    script of the text, as is a known one whose text is in another script. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    bands = bands or BANDS

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            m = measure(batch.column("text"), vocabulary, second)
            failed = base_failed(m)
            kept = ~failed & ~outside_band(m, batch.column("lang").to_pylist(), bands)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(
                        pa.array(m[k], pa.int64())
                        for k in (
                            "n_words",
                            "word_chars",
                            "n_symbols",
                            "n_dup_lines",
                            "n_repeat_words",
                        )
                    ),
                    pa.array(failed),
                    pa.array(kept),
                    pa.array([SCRIPTS[s] for s in m["script"]], pa.string()),
                    pa.array(m["n_tokens"], pa.int64()),
                    pa.array(m["n_bytes"], pa.int64()),
                    pa.array(m["entropy"], pa.float64()),
                    pa.array(m["n_second"], pa.int64()),
                ],
                names=[x.split()[0] for x in OUTPUT.split(", ")],
            )

    rows = exact_columns(docs, "doc_id", "text", "lang")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, OUTPUT)


def keep_good(
    docs: DataFrame,
    vocabulary: str,
    bands: dict[str, Band] | None = None,
    second: tuple[str, str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; see :func:`quality`."""
    bands = bands or BANDS
    names = docs.columns
    at = {n: i for i, n in reversed(list(enumerate(names)))}
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text, lang = f"_{at['text']}", f"_{at['lang']}" if "lang" in at else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            m = measure(batch.column(text), vocabulary, second)
            langs = batch.column(lang).to_pylist() if lang else [None] * batch.num_rows
            kept = ~base_failed(m) & ~outside_band(m, langs, bands)
            yield batch.filter(pa.array(kept))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
