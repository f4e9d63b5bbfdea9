"""Token counts: vocabulary strings that encode alone are counted by lookup, the rest is merged."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import numbers, pick, releasing, rows_as_bytes, small_batches

#: How the byte-level models split a text; White_Space is what their libraries take as \s.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


@lru_cache(4)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that, encoded alone, give exactly one token."""
    model = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    special = {t.content for t in model.get_added_tokens_decoder().values()}
    texts = []
    for s in model.get_vocab(with_added_tokens=True):
        if s not in special and all(c in byte_of for c in s):
            try:
                texts.append(bytes(byte_of[c] for c in s).decode())
            except UnicodeDecodeError:
                continue
    found = model.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, found) if len(e.ids) == 1 and e.offsets[0] == (0, len(t)))


class PieceCounts(dict):
    """Tokens of a pre-token: 1 for the proven strings, else what the model's merges leave."""

    LIMIT = 300_000

    def __init__(self, path: str, proven: frozenset[str]):
        model = Tokenizer.from_file(path)
        told = json.loads(model.to_str())
        if told["normalizer"] or told["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("whole-token counts need a byte-level model without normaliser")
        added = model.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take their surroundings aren't supported")
        self.proven, self.merge, self.letters = proven, model.model.tokenize, byte_letters()
        self.special = regex.compile("|".join(regex.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None
        self.pieces = regex.compile(PIECES).findall
        super().__init__(dict.fromkeys(proven, 1))

    def __missing__(self, piece: str) -> int:
        if len(self) > self.LIMIT + len(self.proven):
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = self[piece] = len(self.merge("".join([self.letters[b] for b in piece.encode()])))
        return n

    def of(self, text: str) -> int:
        if self.special is None or not (hits := len(self.special.findall(text))):
            return sum(map(self.__getitem__, self.pieces(text)))
        return hits + sum(sum(map(self.__getitem__, self.pieces(part))) for part in self.special.split(text))


@lru_cache(2)
def _counter(path: str, proven: frozenset[str]) -> PieceCounts:
    return PieceCounts(path, proven)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text, as the tokenizers library counts them without added begin or end.

    ``docs`` needs ``doc_id`` and ``text``. Returns ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens), one row per input row. A null or empty text has none.
    A null doc_id is carried through, repeated rows are counted each, an empty table gives none.

    A text is split as the model splits it. A piece among the strings proven to encode as one token counts
    one; any other piece goes through the model's merges once and is remembered, within a bound.
    """
    proven = whole_tokens(path)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(path, proven)
        for batch in batches:
            texts = [t or b"" for t in rows_as_bytes(batch, "text")]
            tokens = [counts.of(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [numbers(batch, "doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    small_batches(docs)
    docs = pick(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
