"""Packing of tokenised documents into sequences of a fixed length.

First-fit decreasing: in each randomised group of pieces, longest first, a piece goes to the first open sequence
that has room for it; a tournament tree over the free room of the sequences finds that one in log time.

Contract. Null text: empty. Each document is the ids of its text and then the end id, so an empty text has one
token. Pieces are cut at multiples of the sequence length; only a document's last piece is shorter. Repeated rows are
documents of their own. Ties in length go by document id (null first), start, then input order. An empty table gives
no rows. Other columns of the input, whatever their names, are left out. Groups are dealt by a hash of the piece
and its row, so neither a long document nor a third of all rows under one id lands in one group. The input must be
something Spark can read again in the same order (a table or file), as every stage of the pipeline is.
"""

from __future__ import annotations

import os
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import in_small_batches, settled, whole_text

SEQUENCE = 4096
END_ID = 2
GROUP_PIECES = 2048
#: Chunks of text whose ids a Python worker remembers; it starts anew beyond that.
REMEMBERED = 400_000
#: Bytes of text that are encoded at once.
SLAB = 1_000_000
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, row bigint"
PACKED = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

#: Splitter, normaliser and model settings under which no token reaches over white space and the parts of a chunk can be told here.
PROVED_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PROVED_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

_coders: dict = {}


class _Numbers(dict):
    """Number of each key seen; new ones wait in fresh until their ids are learnt."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n

    def of(self, keys: list):
        import numpy as np

        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class _Lists:
    """Lists of ids by number, in one flat array."""

    def __init__(self):
        import numpy as np

        self.first, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, sizes, ids, order=None) -> None:
        """Lists of these sizes, one behind the other in ids; order: the place of each among the new numbers."""
        import numpy as np

        first = len(self.flat) + np.cumsum(sizes) - sizes
        if order is not None:
            at = np.argsort(order)
            first, sizes = first[at], sizes[at]
        self.first, self.sizes, self.flat = np.concatenate([self.first, first]), np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def take(self, numbers):
        """The ids of the lists with these numbers, one behind the other, and each list's size."""
        import numpy as np

        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def _proved(steps: dict) -> bool:
    """Whether the tokenizer's file has the very steps that Coder knows: NFC, runs of white space to one blank, lower case; a
    splitter whose matches hold no white space, of which everything else is removed; BPE without dropout, unknown or prefix
    forms; special tokens that take no white space in."""
    split = steps.get("pre_tokenizer") or {}
    parts = split.get("pretokenizers") or [{}]
    model = steps.get("model") or {}
    return (
        (steps.get("normalizer") or {}).get("normalizers") == PROVED_STEPS
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": PROVED_SPLIT}
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert") is True
        and not parts[1].get("add_prefix_space")
        and parts[1].get("use_regex") is False
        and model.get("type") == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and all(t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in steps.get("added_tokens", []))
        and not steps.get("post_processor")
    )


class Coder:
    """ids of texts, as the tokenizer gives them without special tokens, truncation and padding.

    Where the tokenizer's file proves that no token reaches over white space, the ids of a text are those of its chunks
    between ASCII white space, each encoded once and then remembered. New chunks of Latin characters only are looked up in a
    lexicon, if there is one, or else lower-cased and split as the tokenizer's own normaliser and splitter would do, and the
    tokenizer's model merges the parts not seen before; any other chunk goes through the whole tokenizer. With any other
    file each text goes through the tokenizer as a whole.
    """

    #: Characters below U+0250 that NFC leaves alone and lower() maps one to one; no white space, no start of a special token.
    PLAIN = "^[!-;=-~\u00a1-\u012f\u0131-\u024f]+$"

    def __init__(self, path: str, lexicon=None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            steps = json.load(f)
        self.lowers = _proved(steps)
        self.joins = steps.get("decoder") is None
        self.tokens = None
        self.lexicon = lexicon
        self.plain = regex.compile(self.PLAIN).match
        self.parts = regex.compile(PROVED_SPLIT).findall
        # byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.chunks, self.ids, self.known, self.part_ids = _Numbers(), _Lists(), _Numbers(), _Lists()
        # beside white space at the edges of a text Arrow's splitter leaves an empty chunk
        self.chunks[""] = 0
        self.ids.add(np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def is_plain(self, chunk: str) -> bool:
        # printable ASCII is told without the pattern
        if chunk.isascii() and chunk.isprintable():
            return "<" not in chunk
        return self.plain(chunk) is not None

    def _parts(self, chunks: list[str]):
        """The parts of plain chunks, all in one list, and each chunk's first part. The splitter's matches hold no white
        space and leave out none but that, so it runs once over all chunks; lengths tell where a chunk begins."""
        import numpy as np

        parts = self.parts("\n".join(chunks).lower())
        begins = np.cumsum([0, *map(len, parts)])
        wanted = np.cumsum([0, *map(len, chunks)])
        firsts = np.searchsorted(begins, wanted)
        if begins[-1] != wanted[-1] or (begins[firsts] != wanted).any():
            raise ValueError("the splitter does not keep all but white space")
        return parts, firsts[:-1]

    def _learn_parts(self) -> None:
        import numpy as np

        ids, sizes = array("I"), []
        tokenize = self.tokenizer.model.tokenize
        for part in self.known.fresh:
            own = [t.id for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet))]
            ids.extend(own)
            sizes.append(len(own))
        self.part_ids.add(np.array(sizes, np.int64), np.frombuffer(ids, np.uint32))
        self.known.fresh = []

    def _learn(self) -> None:
        import numpy as np

        chunks = self.chunks.fresh
        plain = np.fromiter(map(self.is_plain, chunks), bool, len(chunks))
        # places among the new chunks, sizes and ids of each way by which chunks get their ids
        ways = []
        if self.lexicon is not None and plain.any():
            at = np.flatnonzero(plain)
            known, sizes, ids = self.lexicon.find([chunks[i].lower().encode() for i in at])
            ways.append((at[known], sizes, ids))
            ours = at[~known]
        else:
            ours = np.flatnonzero(plain)
        if len(ours):
            parts, firsts = self._parts([chunks[i] for i in ours])
            numbers = self.known.of(parts)
            if self.known.fresh:
                self._learn_parts()
            found, sizes = self.part_ids.take(numbers)
            ways.append((ours, np.add.reduceat(sizes, firsts), found))
        others = np.flatnonzero(~plain)
        if len(others):
            rest = [np.array(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids, np.uint32) for i in others]
            ways.append((others, np.array([len(x) for x in rest], np.int64), np.concatenate(rest)))
        places, sizes, ids = (np.concatenate(x) for x in zip(*ways, strict=True))
        self.ids.add(sizes, ids, places)
        self.chunks.fresh = []

    def ids_of(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def split(self, texts):
        """Lists of the chunks of an Arrow array of strings, in lower case but for texts that may hold a special token."""
        import pyarrow.compute as pc

        return pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))

    def encode(self, texts) -> list:
        """One array of ids per text of an Arrow array of strings. Arrow splits all texts and numbers their distinct chunks;
        only those are looked up one by one."""
        import numpy as np
        import pyarrow.compute as pc

        if not self.lowers:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        if len(self.chunks) > REMEMBERED:
            self.forget()
        split = self.split(texts)
        coded = split.flatten().dictionary_encode()
        numbers = self.chunks.of(coded.dictionary.to_pylist())
        if self.chunks.fresh:
            self._learn()
        ids, sizes = self.ids.take(numbers[coded.indices.to_numpy()])
        begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        edges = begins[np.cumsum(np.concatenate([np.zeros(1, np.int64), pc.list_value_length(split).to_numpy()]))]
        return [ids[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, lists):
        """Arrow array of the texts of an Arrow array of lists of ids. Without a decoder a text is its tokens with a blank between;
        ids that are none are left out, as the tokenizer does."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.joins:
            return pa.array(self.tokenizer.decode_batch(lists.to_pylist(), skip_special_tokens=False), pa.string())
        if self.tokens is None:
            own = [self.tokenizer.id_to_token(i) for i in range(1 + max(self.tokenizer.get_vocab().values()))]
            self.tokens = pa.array(own, pa.string())
        ids = lists.flatten()
        if len(ids) and (ids.null_count or pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(self.tokens)):
            return pa.array([self.tokenizer.decode([i for i in x if i is not None and 0 <= i < len(self.tokens)], skip_special_tokens=False) for x in lists.to_pylist()], pa.string())
        offsets = pc.cumulative_sum(pa.concat_arrays([pa.array([0], pa.int32()), pc.list_value_length(lists)]))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.tokens.take(ids)), " ")


def cuts_at_white_space(path: str) -> bool:
    return coder(path).lowers


def coder(path: str, lexicon=None) -> Coder:
    """The worker's coder for this file; it keeps the lexicon that it was given last."""
    if path not in _coders:
        _coders[path] = Coder(path)
    _coders[path].lexicon = lexicon
    return _coders[path]


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """PIECES of each document: its ids (little-endian unsigned 32-bit) cut at multiples of sequence."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = coder(tokenizer)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "row"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            at, ends = 0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB)) - at)
                own_rows = zip(batch.column(0).slice(at, n).to_pylist(), batch.column(2).slice(at, n).to_pylist(), own.encode(batch.column(1).slice(at, n)), strict=True)
                out: list[list] = [[] for _ in names]
                for doc_id, row, ids in own_rows:
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), sequence):
                        piece = ids[start : start + sequence]
                        for column, value in zip(out, (doc_id, start, len(piece), piece.tobytes(), len(ids), row), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)
                at += n
        # the worker may go on to other stages: most of a task's chunks are its own
        own.forget()
        settled()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"), F.monotonically_increasing_id().alias("row"))
    return in_small_batches(rows).mapInArrow(cut, PIECES)


def first_fit_decreasing(lengths, room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, for lengths in descending order. tree[1] is the largest free room of all bins;
    the leaves hold each bin's, and going left whenever the left half has room finds the first bin that fits."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(room - tree[node])
        tree[node] -= length
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """PACKED pieces of docs (doc_id, text): sequence_id and offset say where each piece lies.

    The number of groups follows the input (its rows, and its bytes for long documents), so a group has about
    group_pieces pieces at any size.
    """
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(whole_text())), F.lit(0))).first()
    groups = max(1, -(-(rows + size // (2 * sequence)) // group_pieces))

    def place(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        order = pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")], null_placement="at_start")
        table = table.take(order)
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), sequence)
        group = table.column("group")[0].as_py()
        ids = (np.int64(group) << np.int64(32)) + np.array(bins, np.int64)
        kept = table.select(["doc_id", "start", "length", "ids", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = pieces(docs, tokenizer, sequence, end_id).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(place, PACKED)
