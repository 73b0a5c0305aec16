"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once on the driver, by the tokenizer itself. Executors cut
a text at ASCII white space, which no pre-token of the tokenizer crosses, look each piece up in a bounded memo, and on a
miss cut it into the tokenizer's own pre-tokens: those with a proof count one, only the rest go through the merges.
Pieces that hold an added token's string are encoded by the tokenizer as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MEMO_ENTRIES = 400_000


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def proved_whole(path: str, suffix: str = "</w>") -> frozenset[str]:
    """Vocabulary strings (without word-end mark, in the tokenizer's byte alphabet) whose text alone gives that one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = [(s.removesuffix(suffix), i) for s, i in tokenizer.get_vocab(with_added_tokens=False).items() if s.endswith(suffix) and s != suffix]
    return frozenset(s for s, i in ends if [t.id for t in tokenizer.model.tokenize(s)] == [i])


# Printable ASCII, and the tokenizer's own split pattern for it (after lower-casing).
_PRINTABLE = re.compile(rb"[!-~]+")
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Parts(dict):
    """Pre-token (in the tokenizer's byte alphabet) -> number of tokens: one if that is proved, else by the merges."""

    def __init__(self, tokenizer, whole: frozenset[str]):
        self.model, self.whole = tokenizer.model, whole

    def __missing__(self, part: str) -> int:
        n = 1 if part in self.whole else len(self.model.tokenize(part))
        if len(self) < MEMO_ENTRIES and len(part) <= 64:
            self[part] = n
        return n


class Counter(dict):
    """Piece of text without ASCII white space (UTF-8) -> number of tokens; a dict so that hits cost one look-up."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Parts(self.tokenizer, whole)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, piece: bytes) -> int:
        n = self.count(piece)
        if len(self) < MEMO_ENTRIES and len(piece) <= 64:
            self[piece] = n
        return n

    def count(self, piece: bytes) -> int:
        if any(a in piece for a in self.added):
            return len(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids)
        if _PRINTABLE.fullmatch(piece):
            parts = _ASCII_PARTS.findall(piece.decode().lower())
        else:
            parts = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece.decode()))]
        return sum(map(self.parts.__getitem__, parts))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed `limit`.

    Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows pass through, a row each; an empty table
    gives an empty result; other columns are not read, whatever their names. Texts of any length are counted whole.
    No shuffle. The proof set is bounded by the vocabulary.
    """
    path = path or word_tokenizer_path()
    whole = proved_whole(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Counter(path, whole)
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            counts = [sum(map(memo.__getitem__, x.split())) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
