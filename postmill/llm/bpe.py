"""BPE encoding and decoding with a lexicon of frequent words.

The words of the whole corpus are counted, and the frequent ones are compiled with their ids into a minimal acyclic
transducer: words with a common beginning share its path, words with a common rest of both letters and ids share its
states, and each id lies on the first arc where it is certain. The transducer is one file of 32-bit numbers that
every Python worker maps into memory, so workers of a machine share it. A word that it does not hold is merged pair by
pair by the tokenizer's own model. The lexicon decides speed only: ids are those of the whole tokenizer for any lexicon.

Contract. Ids are what the tokenizers library gives for the whole text with add_special_tokens=False, without truncation
and padding; decoding gives what its decode(ids, skip_special_tokens=False) gives. Null text: empty, no ids, empty
decoded text. A special token's string in a text is that token. Texts of any length are read whole. Repeated rows,
and rows whose id is null, are rows of their own. Extra columns stay as they are unless they are called `ids` or
`decoded`, which are replaced. Ties in frequency at the lexicon's bound go to the smaller word. An empty table gives no
rows. A tokenizer file whose steps do not prove that white space can be cut at is given whole texts, without lexicon.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from postmill.llm.common import in_small_batches, settled, shared_dir, whole_text
from postmill.llm.packing import SLAB, coder, cuts_at_white_space

#: Words in the lexicon at most, bytes of such a word at most, and how often the corpus holds it at least. Other words are merged.
LEXICON_WORDS, LEXICON_BYTES, LEAST_COUNT = 65_536, 64, 4
_maps: dict = {}


class _State:
    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs: list[list] = []  # byte, ids, target
        self.final: tuple | None = None


def _shared(a, b) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compiled(entries) -> bytes:
    """The transducer of (word as bytes, ids), sorted by word and without repeats, as little-endian 32-bit numbers: six
    counts, then per arc its key (state and byte), target and output, per state its last output (0: no word ends here),
    where each output begins, and the ids of all outputs."""
    import numpy as np

    states: dict = {}
    keys: list[int] = []
    targets: list[int] = []
    arc_outs: list[int] = []
    finals: list[int] = []
    outs: dict = {None: 0, (): 1}

    def frozen(state: _State) -> int:
        """The number of a state equal to this one: a new one only where no other has the same rest."""
        mark = (state.final, tuple((b, o, t) for b, o, t in state.arcs))
        n = states.get(mark)
        if n is None:
            n = states[mark] = len(states)
            for b, o, t in state.arcs:
                keys.append(n << 8 | b)
                targets.append(t)
                arc_outs.append(outs.setdefault(o, len(outs)))
            finals.append(outs.setdefault(state.final, len(outs)))
        return n

    path, last = [_State()], b""
    for word, ids in entries:
        same = _shared(word, last)
        for i in range(len(last), same, -1):
            path[i - 1].arcs[-1][2] = frozen(path[i])
        del path[same + 1 :]
        for b in word[same:]:
            path[-1].arcs.append([b, (), None])
            path.append(_State())
        # ids that this word does not share move one arc on, to the words that went there before
        left = tuple(ids)
        for i in range(1, same + 1):
            arc = path[i - 1].arcs[-1]
            n = _shared(arc[1], left)
            moved, left = arc[1][n:], left[n:]
            arc[1] = arc[1][:n]
            if moved:
                for later in path[i].arcs:
                    # the arc of this word, if new, has none yet
                    if i < same or later is not path[i].arcs[-1] or len(word) == same:
                        later[1] = moved + later[1]
                if path[i].final is not None:
                    path[i].final = moved + path[i].final
        if len(word) > same:
            path[same].arcs[-1][1] = left
            path[-1].final = ()
        else:
            path[-1].final = left
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1].arcs[-1][2] = frozen(path[i])
    root = frozen(path[0])
    pool = [o or () for o in outs]
    begins = np.cumsum([0, *map(len, pool)])
    flat = [x for o in pool for x in o]
    head = [len(keys), len(finals), len(pool), len(flat), root, max((len(w) for w, _ in entries), default=0)]
    return np.concatenate([np.asarray(x, "<u4") for x in (head, keys, targets, arc_outs, finals, begins, flat)]).tobytes()


class Transducer:
    """A compiled lexicon; its numbers may be mapped from a file."""

    def __init__(self, numbers):
        arcs, states, pool, flat, self.root, self.longest = (int(x) for x in numbers[:6])
        edges, at = [], 6
        for n in (arcs, arcs, arcs, states, pool + 1, flat):
            edges.append(numbers[at : at + n])
            at += n
        self.keys, self.targets, self.arc_outs, self.finals, self.begins, self.flat = edges

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        import numpy as np

        if path not in _maps:
            _maps[path] = cls(np.memmap(path, "<u4", mode="r"))
        return _maps[path]

    def find(self, words: list[bytes]):
        """Whether each word is known, how many ids each known one has, and the ids of the known ones, one behind the other.
        All words take a step together, so a step is one search for all their arcs."""
        import numpy as np

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(lengths) - lengths
        going = np.flatnonzero(lengths <= self.longest) if len(self.keys) else np.zeros(0, np.int64)
        at = np.full(len(going), self.root, np.int64)
        who, outs, known = [], [], np.zeros(len(words), bool)
        for step in range(self.longest + 1):
            ends = lengths[going] == step
            if ends.any():
                final = self.finals[at[ends]]
                done = going[ends][final > 0]
                known[done] = True
                who.append(done)
                outs.append(final[final > 0])
                going, at = going[~ends], at[~ends]
            if not len(going):
                break
            key = at << 8 | letters[begins[going] + step]
            arc = np.minimum(np.searchsorted(self.keys, key.astype(np.uint32)), len(self.keys) - 1)
            hit = self.keys[arc] == key
            going, arc = going[hit], arc[hit]
            who.append(going)
            outs.append(self.arc_outs[arc])
            at = self.targets[arc].astype(np.int64)
        if not who:
            return known, np.zeros(0, np.int64), np.zeros(0, np.uint32)
        who, outs = np.concatenate(who), np.concatenate(outs).astype(np.int64)
        of_known = known[who]
        who, outs = who[of_known], outs[of_known]
        order = np.argsort(who, kind="stable")  # steps of a word stay in order
        outs = outs[order]
        first, sizes = self.begins[outs].astype(np.int64), np.diff(self.begins)[outs].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return known, np.bincount(who[order], sizes, len(words)).astype(np.int64)[known], ids


def word_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """word string, n bigint: how often docs hold each word between white space, folded as the tokenizer folds it. Words with
    characters that only the whole tokenizer can fold, and longer ones than LEXICON_BYTES, are left out: none is in a lexicon."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = coder(tokenizer)
        for batch in batches:
            words = own.split(batch.column(0)).flatten()
            found = pc.value_counts(words.filter(pc.and_(pc.greater(pc.binary_length(words), 0), pc.less_equal(pc.binary_length(words), LEXICON_BYTES))))
            fit = [own.is_plain(w) for w in found.field("values").to_pylist()]
            found = found.filter(pa.array(fit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array([w.lower() for w in found.field("values").to_pylist()], pa.string()), found.field("counts").cast(pa.int64())], ["word", "n"])
        settled()

    counted = in_small_batches(docs.select(whole_text(text).alias("text"))).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, tokenizer: str, text: str = "text", most: int = LEXICON_WORDS, least: int = LEAST_COUNT) -> str | None:
    """Counts the words of docs, compiles the most frequent ones, and gives the name under which Spark hands the file to every
    executor, also to those that come later; None if the tokenizer takes whole texts only.

    The file is written to the shared folder under a name made of its content and stays there as long as the session may start executors.
    """
    if not cuts_at_white_space(tokenizer):
        return None
    frequent = word_counts(docs, tokenizer, text).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)
    words = sorted(r["word"].encode() for r in frequent.select("word").toLocalIterator())
    own = coder(tokenizer)
    data = compiled([(w, own.ids_of(w.decode())) for w in words])
    own.forget()
    return _handed_out(docs.sparkSession, data)


def _handed_out(spark: SparkSession, data: bytes) -> str:
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        out = files.create(place, True)
        try:
            for at in range(0, len(data), 1 << 20):
                out.write(bytearray(data[at : at + (1 << 20)]))
        finally:
            out.close()
    spark.sparkContext.addFile(files.makeQualified(place).toString())
    return name


def _fields(df: DataFrame, *less: str) -> list[StructField]:
    return [f for f in df.schema.fields if f.name.lower() not in less]


def encode(docs: DataFrame, tokenizer: str, words: str | None = None, text: str = "text") -> DataFrame:
    """docs with ids array<int>. words: the name that lexicon() gave; without it every word is merged."""
    kept = _fields(docs, "ids")
    if text not in [f.name for f in kept]:
        raise ValueError(f"docs have no column {text}")
    names = [f.name for f in kept]
    at = names.index(text)

    def coded(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import SparkFiles

        own = coder(tokenizer, Transducer.mapped(SparkFiles.get(words)) if words else None)
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            ends, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
            while first < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLAB)) - first)
                found = own.encode(texts.slice(first, n))
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = pa.array(np.concatenate(found).astype(np.int32), pa.int32())
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*names, "ids"])
                first += n
        own.forget()
        settled()

    schema = StructType([*[StructField(f.name, StringType() if f.name == text else f.dataType) for f in kept], StructField("ids", ArrayType(IntegerType()))])
    taken = [F.col(f"`{n}`").cast("string").alias(n) if n == text else F.col(f"`{n}`") for n in names]
    return in_small_batches(docs.select(*taken)).mapInArrow(coded, schema)


def decode(coded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """coded with decoded string, the text of its ids; null ids: empty."""
    kept = _fields(coded, "decoded")
    names = [f.name for f in kept]
    at = names.index(ids)

    def texts(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = coder(tokenizer)
        for batch in batches:
            lists = pc.fill_null(batch.column(at), [])
            sizes, first = pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0
            ends = np.cumsum(sizes)
            while first < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLAB // 4)) - first)
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, own.decode(lists.slice(first, n))], [*names, "decoded"])
                first += n
        settled()

    return in_small_batches(coded.select(*[F.col(f"`{n}`") for n in names])).mapInArrow(texts, StructType([*kept, StructField("decoded", StringType())]))
