"""SentencePiece (merge type) encoding by backtracking, and decoding.

A text's escaped form is cut where no piece can reach across: before a run of ``▁`` (no piece holds
one after another character) and around characters that only stand alone.  Each chunk is encoded by
backtracking: from a position take the longest piece (one Aho-Corasick pass finds the longest at
every position); it may follow the piece before it only if merging the two pieces' joined text
again gives exactly those two; otherwise try its next shorter prefix that is a piece; when none is left,
mark the position as failed in a bitfield and take back the last piece.  The first sequence that
reaches the end is the merge encoding.  Characters outside the vocabulary become byte pieces.

Chunk encodings and pair checks are remembered per worker, up to a fixed number of entries.
Defined results: null is encoded as the empty text; an empty text has only begin and end ids.
"""
from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: entries remembered per worker, of chunks and of pairs
CHUNKS, PAIRS = 400_000, 600_000
#: above every score
NEVER = float("inf")
#: texts that need the careful cut: runs of spaces, spaces at an end or before a line break, a literal mark
_SPACED = re.compile(rf"  | \n|^ | \Z|{SPACE}")


class PieceCodec:
    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
        if (model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback
                or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or model.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("a merge-type model with byte fallback and identity normalisation is needed")
        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos, self.prefix = vocabulary.bos_id(), vocabulary.eos_id(), norm.add_dummy_prefix
        self.piece, self.score, self.id, self.byte = {}, {}, {}, {}
        self.raw = [b""] * len(model.pieces)  # what each id decodes to
        for i, p in enumerate(model.pieces):
            if p.type == kind.NORMAL:
                self.piece[i], self.id[p.piece], self.score[p.piece] = p.piece, i, p.score
                self.raw[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.raw[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type not in (kind.CONTROL, kind.UNKNOWN):
                raise ValueError(f"piece type {p.type} is not supported")
        longer = {c for p in self.id if len(p) > 1 for c in p}
        if any(c not in self.id for c in longer) or any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces must be built of single-character pieces, with spaces in front only")
        line = "" if "\n" in longer else "\n"  # a barrier if it only stands alone
        self.chunks = re.compile(rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (r"|\n" if line else ""))
        self.outside = re.compile("[^" + "".join(map(re.escape, sorted(c for c in self.id if len(c) == 1))) + "]")
        self.finder = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.finder.add_word(p, (i, len(p)))
        self.finder.make_automaton()
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.shorter = {i: next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), None)
                        for i, p in self.piece.items()}
        self.raw_size = np.array([len(r) for r in self.raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.pool = np.frombuffer(b"".join(self.raw), np.uint8)
        self.pairs: dict = {}
        self.edge: dict = {}
        self.barrier = bool(line)
        self.known = _Known(self)
        self.words = _Words(self)

    def edges(self, i: int) -> tuple[list, list] | None:
        """What a piece's first and last symbol are while it is merged, or None if merging ends elsewhere.

        Each as (symbol, least score of the merges up to the one that takes it into a larger symbol).
        """
        if i in self.edge:
            return self.edge[i]
        # merging as trained: the best-scored neighbours first, the leftmost of equals
        parts = list(self.piece[i])
        first, last = [], []
        low = [NEVER, NEVER]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                self.edge[i] = None
                return None
            low = [min(low[0], best), min(low[1], best)]
            if at == 0:
                first.append((parts[0], low[0]))
                low[0] = NEVER
            if at == len(parts) - 2:
                last.append((parts[-1], low[1]))
                low[1] = NEVER
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        for ends in (first, last):
            ends.append((parts[0], -NEVER))
        self.edge[i] = first, last
        return self.edge[i]

    def fits(self, a: int | None, b: int) -> bool:
        """Whether piece b may follow piece a (or begin a chunk): merging again leaves both as they are.

        Merges inside a and inside b go on side by side.  They are disturbed if, at some time, a's last
        and b's first symbol make a piece that scores better than what either of them waits for.  Of
        equal scores the leftmost merge comes first: a's own, then the one across, then b's own.
        """
        key = -1 - b if a is None else a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            found = self._remerge(a, b)
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _remerge(self, a: int | None, b: int) -> bool:
        left, right = self.edges(a) if a is not None else ((), ()), self.edges(b)
        if left is None or right is None:
            return False
        if a is None:
            return True
        ends, starts, score, i, j = left[1], right[0], self.score, 0, 0
        while True:
            (x, wait_x), (y, wait_y) = ends[i], starts[j]
            across = score.get(x + y)
            if across is not None and across > wait_x and across >= wait_y:
                return False
            if wait_x == wait_y == -NEVER:
                return True
            if wait_x >= wait_y:
                i += 1
            else:
                j += 1

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        longest: list = [None] * len(text)
        for end, (i, n) in self.finder.iter(text):
            longest[end - n + 1] = i  # ends ascend, so the longest from a position comes last
        length, shorter, fits = self.length, self.shorter, self.fits
        ids: list[int] = []
        at, failed, last, size = 0, 0, None, len(text)
        token = longest[0]
        while at < size:
            while token is not None:
                end = at + length[token]
                if not failed >> end & 1 and fits(last, token):
                    break
                token = shorter[token]
            if token is None:  # nothing fits here: take back the last piece and try shorter ones
                failed |= 1 << at
                token = ids.pop()
                at -= length[token]
                last, token = ids[-1] if ids else None, shorter[token]
                continue
            ids.append(token)
            at, last = end, token
            token = longest[at] if at < size else None
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        ids, at = [], 0
        for m in self.outside.finditer(chunk):
            if m.start() > at:
                ids += self.backtrack(chunk[at: m.start()])
            ids += [self.byte[b] for b in m[0].encode("utf-8", "surrogatepass")]
            at = m.end()
        return ids + self.backtrack(chunk[at:]) if at < len(chunk) else ids

    def encode(self, text: str | None) -> np.ndarray:
        """All ids, with begin and end."""
        body = b""
        if text:
            if self.prefix and self.barrier and not _SPACED.search(text):
                body = b"".join(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))
            else:
                escaped = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
                body = b"".join(map(self.known.__getitem__, self.chunks.findall(escaped)))
        return np.concatenate([[self.bos], np.frombuffer(body, "<u4"), [self.eos]]).astype("<u4")

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        sizes = self.raw_size[ids]
        begins = np.cumsum(sizes) - sizes
        # every byte's place in the pool of all pieces' bytes
        raw = self.pool[np.arange(int(sizes.sum())) + np.repeat(self.raw_at[ids] - begins, sizes)].tobytes()
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class _Known(dict):
    """Chunk -> its ids as little-endian 32-bit integers."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec = codec

    def encode(self, chunk: str) -> bytes:
        return np.array(self.codec.encode_chunk(chunk), "<u4").tobytes()

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= 64:  # longer ones hardly come again
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        return self.keep(chunk, self.encode(chunk))


class _Words(_Known):
    """The same for texts with single spaces only: a word with the space before it, or with a line break."""

    def __missing__(self, word: str) -> bytes:
        known = self.codec.known
        if word.startswith("\n"):
            ids = known["\n"] + (known.encode(word[1:]) if len(word) > 1 else b"")
        else:
            ids = known.encode(SPACE + word)
        return self.keep(word, ids)


@functools.lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec per worker and model."""
    return PieceCodec(model_file)


def encoder(model_file: str):
    """Column function: text -> array<int> of ids."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        c = codec(model_file)
        return pd.Series([c.encode(t) for t in texts], dtype=object)
    return encode


def decoder(model_file: str):
    """Column function: array<int> of ids -> text."""
    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        c = codec(model_file)
        return pd.Series([c.decode(i) for i in ids], dtype=object)
    return decode


def digests(model_file: str):
    """Column function: array<int> of ids -> n_tokens, ids_sha256, decoded_sha256."""
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}

    @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in kinds.items()]))
    def digest(ids: pd.Series) -> pd.DataFrame:
        c = codec(model_file)
        return pd.DataFrame([(len(i), hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest(),
                              hashlib.sha256(c.decode(i).encode()).hexdigest()) for i in ids], columns=list(kinds))
    return digest
