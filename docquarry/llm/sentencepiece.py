"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.common import small_batches, table, trimmed

#: Model file of the registered query; any SentencePiece model with byte pieces or an unknown piece will do.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: The character that stands for a blank in pieces.
BLANK = "▁"
#: Below the least score of all pieces by this, as SentencePiece scores characters without a piece.
UNKNOWN_PENALTY = 10.0
#: Units longer than this many characters are not remembered; the last MEMO to twice MEMO that came
#: up are, and as many pairs of pieces.
MEMO_CHARS, MEMO = 48, 3 << 16


class Memo(dict):
    """Remembers what a function gives, so that a lookup costs no call. Bounded: when MEMO entries
    are new, those not asked for since the last time go."""

    def __init__(self, of: Callable):
        self.of, self.old = of, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.of(key)
        if type(key) is not str or len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


@dataclass(frozen=True)
class Pieces:
    """A model's vocabulary: a few hundred kB at most for any published model, so it is shipped with the tasks."""

    names: list[str]
    scores: list[float]
    #: Id of the piece of each byte; empty without byte pieces.
    byte_ids: list[int]
    #: Ids that stand for no text: control and unknown pieces.
    silent: frozenset[int]
    unknown_id: int
    #: Whether the scores are ranks of merges (a BPE model), not logarithms of probabilities.
    merges: bool


def load_pieces(path: str) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    by_name = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
    ranks = [model.get_score(i) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return Pieces(
        [model.id_to_piece(i) for i in range(n)],
        [model.get_score(i) for i in range(n)],
        [by_name[f"<0x{b:02X}>"] for b in range(256)] if len(by_name) == 256 else [],
        frozenset(i for i in range(n) if model.is_control(i) or model.is_unknown(i)),
        model.unk_id(),
        all(r == int(r) for r in ranks),
    )


class Codec:
    """Encodes, by an automaton's matches and one pass over their ends, and decodes.

    In a model of probabilities each match relaxes the best sum of scores at its end. In a model of
    merges the score of a segmentation is whether merging by rank would give it, which holds if it
    holds for each piece with the one before it; every place has exactly one such last piece, and
    the ids are those of the SentencePiece library.

    One blank is put before the text and blanks become the blank sign, as the public models have
    it. A character without a piece, and a blank sign in the text itself, become their UTF-8 byte
    pieces (or the unknown piece, in a model without byte pieces), so that decoding gives back
    every text exactly. Where no piece has a blank after another character, which loading checks,
    the best segmentation of a text is that of its words one by one; those of short words are
    remembered, up to a bound.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        plain = set(range(len(pieces.names))) - set(pieces.byte_ids) - pieces.silent
        scores = [pieces.scores[i] for i in plain]
        self.floor = min(scores) - UNKNOWN_PENALTY
        self.single: set[str] = set()
        crossing = False
        for i in sorted(plain):
            name = pieces.names[i].replace(BLANK, " ")
            self.automaton.add_word(name, (len(name), pieces.scores[i], i))
            crossing |= re.search(r"[^ ] ", name) is not None
            if len(name) == 1:
                self.single.add(name)
        self.automaton.make_automaton()
        self.units = re.compile(r"(?s).+" if crossing else r" *[^ ]+| +").findall
        self.score_of = {pieces.names[i].replace(BLANK, " "): (pieces.scores[i], i) for i in plain}
        self.text_of = {i: name for name, (_, i) in self.score_of.items()}
        segment = self.merged if pieces.merges else self.best
        self.memo = Memo(lambda unit: array("i", segment(unit)).tobytes())
        self.pairs = Memo(self._apart)
        byte_of = {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        self.bytes_of = [
            byte_of.get(i, b"" if i in pieces.silent else name.replace(BLANK, " ").encode()) for i, name in enumerate(pieces.names)
        ]

    def _rare(self, char: str) -> list[int]:
        return [self.pieces.byte_ids[b] for b in char.encode()] if self.pieces.byte_ids else [self.pieces.unknown_id]

    def best(self, unit: str) -> tuple[int, ...]:
        """The best segmentation of a unit: the automaton's matches come by their end, longest
        first, and each relaxes the score at its end from that at its start."""
        n = len(unit)
        score, back = [0.0] + [-1e300] * n, [(0, -1)] * (n + 1)
        single, floor, done = self.single, self.floor, 0
        for last, (length, value, piece) in self.automaton.iter(unit):
            end = last + 1
            while done < last:  # characters before this end that no piece may have closed
                done += 1
                if unit[done - 1] not in single and score[done - 1] + floor > score[done]:
                    score[done], back[done] = score[done - 1] + floor, (done - 1, -1)
            if score[end - length] + value > score[end]:
                score[end], back[end] = score[end - length] + value, (end - length, piece)
        while done < n:
            done += 1
            if unit[done - 1] not in single and score[done - 1] + floor > score[done]:
                score[done], back[done] = score[done - 1] + floor, (done - 1, -1)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            out += [piece] if piece >= 0 else self._rare(unit[start:at])[::-1]
            at = start
        return tuple(out[::-1])

    def by_merging(self, text: str) -> list[str]:
        """Merge neighbours that are a piece together, those of the best rank first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.score_of.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether merging the text of both pieces (or of the second, after -1) gives just them."""
        texts = [self.text_of[i] for i in pair if i >= 0]
        return self.by_merging("".join(texts)) == texts

    def merged(self, unit: str) -> tuple[int, ...]:
        """What merging by rank makes of a unit: at each end the match, longest first, that stays
        apart from the last piece before it."""
        n = len(unit)
        last: list[int | None] = [-1] + [None] * n
        size, pairs = [0] * (n + 1), self.pairs
        if not self.single.issuperset(unit):
            for i, char in enumerate(unit):
                if char not in self.single:
                    last[i + 1] = -1  # a character without a piece, which nothing merges with
        for end, (length, _, piece) in self.automaton.iter(unit):
            end += 1
            if last[end] is None:
                before = last[end - length]
                if before is not None and pairs[before, piece]:
                    last[end], size[end] = piece, length
        out: list[int] = []
        at = n
        while at:
            if size[at]:
                out.append(last[at])
                at -= size[at]
            elif last[at] is None:
                raise ValueError(f"no segmentation of {unit!r}")
            else:
                out += self._rare(unit[at - 1])[::-1]
                at -= 1
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> array:
        """Piece ids of a text; none for an empty one."""
        out = array("i")
        if text:
            for i, part in enumerate((" " + text).split(BLANK)):
                if i:
                    out.extend(self._rare(BLANK))
                out.frombytes(b"".join(map(self.memo.__getitem__, self.units(part))))
        return out

    def decode(self, ids: array) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


#: The codec of this process and the names of its pieces, kept from task to task.
_own: dict[int, tuple[Pieces, Codec]] = {}


def codec_of(pieces: Pieces) -> Codec:
    known = _own.get(0)
    if known is None or known[0] != pieces:
        _own[0] = (pieces, Codec(pieces))
    return _own[0][1]


def _encoder(pieces: Pieces, keep: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(pieces)
        bytes_first = pieces.byte_ids[0] if pieces.byte_ids else -1
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, n_bytes, digests, same = [], [], [], []
                for value in part.column("text"):
                    text = value.as_py() or ""
                    ids = codec.encode(text)
                    flat = np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32)
                    found.append(flat)
                    n_bytes.append(int(((flat >= bytes_first) & (flat < bytes_first + 256)).sum()) if bytes_first >= 0 else 0)
                    digests.append(hashlib.sha256(flat.tobytes()).hexdigest())
                    same.append(codec.decode(ids) == text)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_tokens": pa.array(np.diff(ends).astype(np.int64)),
                        "n_byte_tokens": pa.array(n_bytes, pa.int64()),
                        "ids_sha256": digests,
                        "round_trip": same,
                        "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32))),
                    }
                    | {c: part.column(c) for c in keep}
                )

    return run


def encode_documents(docs: DataFrame, pieces: Pieces, keep: Sequence[str] = ()) -> DataFrame:
    """Piece ids of every whole text, and whether decoding them gives back the text.

    Null and empty texts have no ids. Null doc_ids and repeated rows are kept as they come, other
    columns are ignored but for those of `keep`, an empty table gives an empty result.

    Returns doc_id, n_tokens, n_byte_tokens, ids_sha256 (of the ids as little-endian int32),
    round_trip, ids, and the columns of `keep`.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *keep).mapInArrow(
        trimmed(_encoder(pieces, keep)),
        f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean, ids array<int>" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    """Every document encoded with the public model's pieces, and decoded again."""
    return encode_documents(table(spark, sf_dir, "documents"), load_pieces(model_path))
