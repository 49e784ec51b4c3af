"""SentencePiece encoding and decoding for vocabularies of merge type.

A score-ordered agenda holds the adjacent pairs of symbols whose union is a piece. The best pair merges
(ties: the leftmost), its neighbours enter the agenda, until none is left; symbols that are no pieces
become their bytes. Two neighbouring characters that no piece holds side by side never come into one
symbol, so that a text falls into parts which merge independently: segments, which begin with space signs,
and in them atoms. Each worker keeps the segments and atoms it has met. New atoms, apart from those with a
line feed, are checked against the sentencepiece library, both ways. Whole documents are checked by sample:
the first of each 500 of an Arrow batch, so that cutting and joining is unchecked for the others.

Defined results: a null text counts as empty, with just the begin and end ids; repeated rows and null ids
are kept; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from maskwerk.llm.common import Resting, documents

SPACE = "▁"
#: Segments: space signs and what follows them up to the next one, or a part of a line without, or line feeds.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")
#: Segments and atoms that a worker keeps, about 180 bytes each; beyond that it starts anew.
KEPT = 1_200_000
LONGEST_KEPT = 64


class AgendaBPE(Resting):
    """Encoder and decoder over the pieces of a sentencepiece model file of merge type."""

    def __init__(self, path: str):
        super().__init__()
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: -lib.get_score(i) for i in plain}
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.shown = ["" if lib.is_control(i) else p for i, p in enumerate(self.pieces)]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.scores):
            raise ValueError("pieces cross words or lines; segments would not merge independently")
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        #: What segments decode to, where it is not their own text.
        self.other: dict[str, str] = {}

    def merge(self, symbols: str) -> list[int]:
        """Ids of one segment, by the agenda."""
        scores = self.scores
        parts: list[str | None] = list(symbols)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(s, i, p) for i in range(n - 1) if (s := scores.get(p := parts[i] + parts[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            if parts[i] is None or (j := right[i]) >= n or parts[i] + parts[j] != p:
                continue  # one of the two has merged since
            parts[i], parts[j] = p, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (s := scores.get(q := p + parts[k])) is not None:
                    heapq.heappush(agenda, (s, i, q))
            if (h := left[i]) >= 0 and (s := scores.get(q := parts[h] + p)) is not None:
                heapq.heappush(agenda, (s, h, q))
        out: list[int] = []
        for p in parts:
            if p is not None:
                if (i := self.ids.get(p)) is not None:
                    out.append(i)
                else:
                    out += [self.byte_ids[b] for b in p.encode()]
        return out

    def unpiece(self, ids: list[int]) -> str:
        """Text of a segment's ids, space signs still in it; bytes that are no UTF-8 become U+FFFD each."""
        if self.bytes.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i is not None:
                out.append(self.shown[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.unpiece(ids)
        return text.removeprefix(SPACE).replace(SPACE, " ")

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def atoms(self, segment: str) -> list[str]:
        pairs = self.pairs
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in pairs]
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)] if cuts else [segment]

    def learn(self, segments: list[str]) -> None:
        """Encodes and decodes new segments; their new atoms are held against the library."""
        known = self.known
        cut = {s: self.atoms(s) for s in segments}
        for x in cut.values():
            for a in x:
                known[a]  # noqa: B018 - notes what is missing
        new = [*known.missed]
        known.missed.clear()
        for a in new:
            known[a] = array("I", self.merge(a)).tobytes()
            if (back := self.unpiece(array("I", known[a]).tolist())) != a:
                self.other[a] = back
        # Between line feeds the library merges each atom by itself.
        for at in range(0, len(new), 10_000):
            part = [a for a in new[at : at + 10_000] if "\n" not in a]
            text = "".join([f"\n{a}" for a in part]).replace(SPACE, " ")
            feed = array("I", [self.byte_ids[10]]).tobytes()
            own = array("I", b"".join([feed + known[a] for a in part])).tolist()
            theirs = self.library.encode(text)
            back = "".join(["\n" + self.other.get(a, a) for a in part]).replace(SPACE, " ")
            if part and (theirs[1:] != own or self.library.decode(theirs) != back):
                raise ValueError(f"the agenda and the library differ on one of {part[:20]} ...")
        for s, parts in cut.items():
            if len(parts) > 1:
                known[s] = b"".join([known[a] for a in parts])
                if any(a in self.other for a in parts):
                    self.other[s] = "".join([self.other.get(a, a) for a in parts])

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids (little-endian, 4 bytes each, with begin and end) and decoded text of each text."""
        begin, end = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        known = self.known = self.known.renewed(KEPT)
        split = [self.segments(t) for t in texts]
        # One look-up for each segment; those not met yet stand for themselves until they are learnt.
        met = [list(map(known.__getitem__, parts)) for parts in split]
        new = [*known.missed]
        known.missed.clear()
        self.learn(new)
        for k, (text, parts) in enumerate(zip(texts, split, strict=True)):
            ids = begin + b"".join([x if type(x) is bytes else known[x] for x in met[k]]) + end
            back = "".join([self.other.get(s, s) for s in parts] if self.other else parts)[1:].replace(SPACE, " ")
            if not k and (array("I", ids).tolist() != self.library.encode(text, add_bos=True, add_eos=True) or back != self.library.decode(array("I", ids).tolist())):
                raise ValueError("the agenda and the library differ on a document")
            yield ids, back
        for s in [s for s in new if len(s) > LONGEST_KEPT]:
            known.pop(s, None)


_loaded: dict[str, AgendaBPE] = {}


def loaded(path: str) -> AgendaBPE:
    if path not in _loaded:
        _loaded[path] = AgendaBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, full: bool = True) -> DataFrame:
    """For each document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if full, ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(model)
        with coder.awake():
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                    for ids, back in coder.batch([t or "" for t in part["text"].to_pylist()]):
                        rows["n_tokens"].append(len(ids) // 4)
                        rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                        rows["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                        if full:
                            rows["ids"].append(array("I", ids).tolist())
                            rows["decoded"].append(back)
                    out = {"doc_id": part["doc_id"], "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "ids_sha256": pa.array(rows["ids_sha256"], pa.string()), "decoded_sha256": pa.array(rows["decoded_sha256"], pa.string())}
                    if full:
                        out |= {"ids": pa.array(rows["ids"], pa.list_(pa.int32())), "decoded": pa.array(rows["decoded"], pa.string())}
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), full=False)
