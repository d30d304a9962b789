"""Byte-level BPE as a finite-state transducer.

The merge ranks are compiled into a transducer over bytes whose states are made as texts need them. The BPE
encoding of a prefix ends in a last token; what comes before that token is the encoding of a shorter prefix. So
a state holds, for each place where a vocabulary token may still be open, how far into the vocabulary trie it
has come and the tokens of the prefix before it, back to where all open places agree. On a byte every open place
steps in the trie; where a token ends it may follow its prefix if the merges would leave the pair apart, and
exactly one place fits. Tokens on which all open places agree are put out. No place stays open longer than the
longest vocabulary entry, which bounds the lookahead. States and arcs are kept by their content, up to
``max_states``; what comes later is worked out each time, which costs time and changes nothing.

Decoding joins the bytes of ids in blocks and runs an incremental UTF-8 machine over them, so a character may
straddle blocks.
"""

from __future__ import annotations

import array
import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .held import held, tidy

#: Ids that are decoded at a time.
BLOCK = 4096
#: Pieces per generation of a codec's memory.
HELD_PIECES = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Transducer:
    """Encodes pieces; ``encode_piece`` gives the ids that merging by rank gives."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 100_000):
        self.ranks = ranks
        self.max_states = max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                step = self.children[node].get(b)
                if step is None:
                    step = len(self.children)
                    self.children[node][b] = step
                    self.children.append({})
                    self.ends.append(-1)
                node = step
            self.ends[node] = i
        self.apart: dict[tuple[int, int], bool] = {}
        # The start state: one open place at the root, nothing before it.
        start = ((0, ()), -1)
        self.ids: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, text: bytes) -> list[int]:
        """Merging by rank as defined, for short texts: the pairs that the transducer asks about."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, before: int, token: int) -> bool:
        """Whether the merges leave the two tokens as they are when they meet."""
        key = (before, token)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= 250_000:
                self.apart.clear()
            known = self.apart[key] = self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known

    def alone(self, token: int) -> bool:
        """Whether a token's bytes encode to that token."""
        known = self.apart.get((-1, token))
        if known is None:
            known = self.apart[(-1, token)] = self.merged(self.bytes_of[token]) == [token]
        return known

    def step(self, state: tuple, last: int, byte: int) -> tuple[tuple, tuple[int, ...], int]:
        """The next state, the tokens put out, and the last of them.

        A place is (trie node, tokens since all places agreed); ``last`` is the token before those, -1 for none.
        """
        places, full, children, ends = [], None, self.children, self.ends
        for node, since in state:
            to = children[node].get(byte)
            if to is None:
                continue
            if children[to]:
                places.append((to, since))
            token = ends[to]
            if token >= 0 and full is None:
                before = since[-1] if since else last
                if self.alone(token) if before < 0 else self.may_follow(before, token):
                    full = (*since, token)
        if full is None:
            raise ValueError("the ranks do not cover every byte")
        agreed, shortest = 0, len(full)
        for _, since in places:
            if len(since) < shortest:
                shortest = len(since)
        while agreed < shortest:
            token = full[agreed]
            if any(since[agreed] != token for _, since in places):
                break
            agreed += 1
        places.append((0, full))
        out = full[:agreed]
        # What came before all open tokens matters only while a place has none open.
        last = -2 if agreed < shortest else out[-1] if out else last
        return tuple((node, since[agreed:]) for node, since in places), out, last

    def run(self, piece: bytes) -> tuple[int, ...]:
        out: list[int] = []
        arcs, state, content = self.arcs, 0, self.states[0]
        for b in piece:
            arc = arcs[state].get(b) if state >= 0 else None
            if arc is None:
                # The token before the open ones decides what may follow, so it is part of a state's content.
                to, tokens, last = self.step(content[:-1], content[-1], b)
                content = (*to, last)
                n = self.ids.get(content, -1)
                if n < 0 and len(self.states) < self.max_states:
                    n = self.ids[content] = len(self.states)
                    self.states.append(content)
                    arcs.append({})
                if state >= 0 and n >= 0:
                    arcs[state][b] = (n, tokens)
                state = n
            else:
                state, tokens = arc
                content = self.states[state]
            if tokens:
                out.extend(tokens)
        out.extend(content[-2][1])  # the place that is at the root has all tokens of the piece
        return tuple(out)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else self.run(piece)


class Codec:
    """Texts to ids and back for one rank file and one pattern of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        # Short pieces already encoded, in two generations of bounded size: when the new one is full it becomes the old.
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def look_up(self, piece: str) -> tuple[int, ...]:
        """A piece that is not in the new generation."""
        found = self.old.get(piece)
        if found is None:
            found = self.transducer.encode_piece(piece.encode("utf-8"))
        if len(piece) <= 32:
            if len(self.new) >= HELD_PIECES:
                self.old, self.new = self.new, {}
            self.new[piece] = found
        return found

    def encode(self, text: str) -> array.array:
        ids = array.array("I")
        extend = ids.extend
        for piece in self.find(text):
            extend(self.new.get(piece) or self.look_up(piece))
        return ids

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text in blocks, by an incremental UTF-8 machine; ids that end within a character raise."""
        machine = codecs.getincrementaldecoder("utf-8")("strict")
        of = self.transducer.bytes_of.__getitem__
        ids = ids if isinstance(ids, array.array) else array.array("I", ids)
        for at in range(0, len(ids), BLOCK):
            yield machine.decode(b"".join(map(of, ids[at : at + BLOCK])))
        yield machine.decode(b"", final=True)


def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return held(("bpe", path, pattern), lambda: Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Encode every text and decode it again.

    rank_path: a rank file that every worker can open; pattern: what cuts texts into pieces.
    Returns ``id_col``, n_tokens, ids (array<int>; left out if ``ids`` is False), ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded UTF-8), round_trip (the decoded text is
    the text). Null texts are as empty ones: no ids, round_trip true. Repeated rows give a row each; an empty table
    gives none; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([f for f in fields if ids or f.name != "ids"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_path, pattern)
        for batch in tidy(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, lists, id_sha, out_sha, same = [], [], [], [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    got = c.encode(text)
                    sha, equal, pos = hashlib.sha256(), True, 0
                    for chunk in c.decode(got):
                        sha.update(chunk.encode("utf-8"))
                        equal = equal and text.startswith(chunk, pos)
                        pos += len(chunk)
                    n.append(len(got))
                    if ids:
                        lists.append(np.frombuffer(got, dtype=np.int32))
                    id_sha.append(hashlib.sha256(got.tobytes()).hexdigest())
                    out_sha.append(sha.hexdigest())
                    same.append(equal and pos == len(text))
                columns = [part.column(0), pa.array(n, pa.int64())]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *lists])))
                columns += [pa.array(id_sha, pa.string()), pa.array(out_sha, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(id_col, text_col).mapInArrow(work, schema)
