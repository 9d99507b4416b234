"""Token ids of many texts at once, equal to the tokenizers library's ids for each whole text."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from secondcart.llm.common import codes, joined, offsets_of, per_process, ragged, sums, words

# Words made of these characters only lower-case and split the same way everywhere: printable
# ASCII and the Latin-1 letters.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
ALL_PLAIN = re.compile(r"[ -~À-ÖØ-öø-ÿ]*\Z")
# The vocabulary file's split rule, for plain characters in lower case; a blank ends a word.
PIECE = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
SPECIAL = "<|"
KEPT_PIECES = 200_000
PIECES_PER_LINE = 200


class WordTokenizer:
    """Encodes words with a vocabulary whose split rule never crosses white space.

    ``word_bpe_49k.json`` drops white space before it merges, so the ids of a text are the ids of
    its white-space separated words, one after another. Each distinct word of a batch is split
    into pieces once, and each distinct piece is encoded once; up to ``KEPT_PIECES`` pieces are
    remembered between batches. Words with other than plain characters go to the library whole.
    """

    def __init__(self, path: str):
        # One task is one thread; Spark runs the tasks side by side.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer(self.whole.model)
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.dtype = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        # Entry 0 is the blank, which has no ids.
        self.at: dict[str, int] = {" ": 0}
        self.ids = np.zeros(0, self.dtype)
        self.ends_at = np.zeros(1, np.int64)

    def _encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        step = PIECES_PER_LINE
        lines = [" ".join(new[i : i + step]) for i in range(0, len(new), step)]
        ids = np.concatenate(
            [
                np.array(e.ids, dtype=self.dtype)
                for e in self.parts.encode_batch_fast(lines, add_special_tokens=False)
            ]
        )
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("this vocabulary does not mark word ends")
        return ids, ends

    def _pieces(self, line: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of blank-separated plain words, flat, and the number of ids of each word."""
        pieces = PIECE.findall(line.lower())
        kept = len(self.at)
        new = list(set(pieces).difference(self.at))
        ids, ends = self.ids, self.ends_at
        if new:
            self.at.update(zip(new, range(kept, kept + len(new)), strict=True))
            more, more_ends = self._encode_pieces(new)
            ends = np.concatenate([ends, more_ends + len(ids)])
            ids = np.concatenate([ids, more])
        use = np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))
        if len(self.at) <= KEPT_PIECES:
            self.ids, self.ends_at = ids, ends
        else:
            for piece in new:
                del self.at[piece]
        starts = np.concatenate([[0], ends[:-1]])
        size = ends[use] - starts[use]
        blanks = np.flatnonzero(use == 0)
        word_offsets = np.concatenate([[0], blanks, [len(use)]])
        return ids[ragged(size, starts[use])], sums(size, word_offsets)

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and the number of ids of each."""
        line = joined(distinct)
        if SPECIAL not in line and ALL_PLAIN.match(line):
            return self._pieces(line)
        distinct = line.split(" ")
        plain = np.array([bool(PLAIN.match(w)) and SPECIAL not in w for w in distinct])
        lengths = np.zeros(len(distinct), np.int64)
        parts = []
        if plain.any():
            some = [w for w, p in zip(distinct, plain, strict=True) if p]
            ids, lengths[plain] = self._pieces(" ".join(some))
            parts.append(ids)
        odd = [w for w, p in zip(distinct, plain, strict=True) if not p]
        encoded = [
            np.array(e.ids, dtype=self.dtype)
            for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)
        ]
        lengths[~plain] = [len(e) for e in encoded]
        # Plain words come first in the flat ids; bring all into the order of ``distinct``.
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts = np.zeros(len(distinct), np.int64)
        starts[order] = offsets_of(lengths[order])[:-1]
        return np.concatenate([*parts, *encoded])[ragged(lengths, starts)], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the offset of each text's first id. NULL has none."""
        flat, offsets = words(texts)
        if len(flat) == 0:
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        distinct, index = codes(flat)
        ids, lengths = self._words(distinct)
        starts = offsets_of(lengths)[:-1]
        size = lengths[index]
        return ids[ragged(size, starts[index])], offsets_of(size)[offsets]


def word_tokenizer(path: str) -> WordTokenizer:
    return per_process(f"words:{path}", lambda: WordTokenizer(path))
