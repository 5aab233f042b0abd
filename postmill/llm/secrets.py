"""Secret scans.

Fixed patterns give the base spans. The method adds candidate strings, long runs of key-like characters, whose
Shannon entropy in some window reaches the limit of their character class. The window slides one character at a time:
its counts per character, packed twelve to a 64-bit number, change by one that enters and one that leaves, and the sum of
c * log2(c) with them, so a candidate takes time in proportion to its length. What is on
the allow-list (well-known examples, alphabets, long runs of one kind) counts as FILL in these windows, so a window that
lies on it stays below the limit and the windows beside it count. A candidate that is on the list as a whole (a path of words,
digits) is suppressed. A candidate is cut at base spans, and each part is tested by itself.

What people write is taken off before windows are measured: runs of letters whose pairs are frequent in words, whole numbers
between separators, and separators themselves count as FILL, so of a path, an identifier or a slug little is left, and of a
random key nearly all. Two measures must both reach their limits: with runs of RUNS[0] pairs taken off and, lower, with the
shorter runs of RUNS[1] too. Universally unique ids and file digests written as such (`sha512-...`) are on the allow-list. Of 1000
paths, identifiers, slugs, dates, ids and digests made of a tokenizer's words at most 2 % are marked, of random keys of 24 to 64
characters 95 % and more are found (tests).

Letters of one case cannot tell words from random letters by entropy alone. They are taken for random where a window has
UNCOMMON pairs of letters that are rare in words; of random strings of 20, 40 and 64 lower-case letters 98.2 %, 99.9 % and 100 % have
such a window, of words of the test documents run together none of 1500 at each length.

Contract. Null text: empty, no spans. Positions count code points, end exclusive. Base matches are the leftmost
non-overlapping ones per kind; those that fail their length test are dropped without a retry. Texts of any length are
scanned whole. Repeated rows give repeated results; an empty table gives none; other columns stay (columns named
spans or redacted are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import count_of, joined_spans, located, marked_parts, unmarked, whole_text

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run that is too short fails wherever it is entered, so the length test can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")
# a run is entered at its beginning only
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WINDOW = 20
#: Counts of a window's characters, up to 31, stand in so many bits each and so many to a number.
COUNT_BITS, PACKED = 5, 12
#: class of a candidate: its pattern, and the least entropy in bits that some window must have, without long and without all runs of words.
CLASSES = (
    ("hex", "^[0-9a-fA-F]+$", 3.0, 0.0),
    ("letters", "^[a-z/_=-]+$|^[A-Z/_=-]+$", 4.1, 0.0),
    ("word", "^[A-Z]?[a-z/_=-]+$", 4.1, 0.0),
    ("one_case", "^[a-z0-9+/_=-]+$|^[A-Z0-9+/_=-]+$", 3.4, 3.3),
    ("key", "^", 3.6, 3.4),
)
#: Frequent pairs in a row that make a run of a word, and what stands for the run.
RUNS = ((3, "===="), (2, "==="))
#: Strings that look like secrets and are none.
ALLOWED = (
    "(?i)example", "(?i)abcdefghij", "0123456789", "1234567890", r"(.)\1{5}", "^[A-Za-z]+([-_/][A-Za-z]+)+$", "^[0-9/_=-]+$",
    "(?i)(?<![0-9a-f])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-f])", "(?i)sha(?:1|256|384|512)[-_=][A-Za-z0-9+/]{27,}={0,2}", "(?<![A-Za-z0-9])[vV]?[0-9]{1,8}(?![A-Za-z0-9])",
)
#: What stands for an allow-listed match within a window, and how far a match at the alphabet's start goes on.
FILL = "======"
ONWARD = "".join(f"{c}?" for c in "klmnopqrstuvwxyz")
#: Each letter with those that often follow it in English, German, French and Spanish words.
FOLLOWING = "aabcdegilmnoprstuvy beloy cahiot daeilotuw eabcdeghilmnopqrstuvz faior gaceo habcehilnoprst iacdegilmnorstv ja ke ladeiloy maeip nabcdeghilmnopqrstuvwz oacdefiklmnoprstuw paflor qu rabcdeghilnorstvy sabcdeghijlmoqrstuw tabehiorstwz uabceilmnoprstx veio waehio xae ylo zau".split()
UNCOMMON, LEAST_BITS = 8, 3.2


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def walked(text: Column, window: int = WINDOW) -> Column:
    """struct<best: the largest entropy in bits of a window of text (0 if it is shorter), odd: whether some window has
    UNCOMMON pairs of letters that are rare in words, and no few letters only>. window: at most 31."""
    gain = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    often = {own[0]: own[1:] for own in FOLLOWING}
    seldom = F.array(*[F.lit("".join(c for c in LETTERS if c not in often[a])) for a in LETTERS])
    none = F.lit(0).cast("bigint")

    def rare(a: Column, b: Column) -> Column:
        # null where a is no letter
        return F.coalesce(F.contains(F.get(seldom, F.instr(F.lit(LETTERS), F.lower(a)) - 1), F.lower(b)), F.lit(False)).cast("int")

    def described(chars: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            code = F.instr(F.lit(SYMBOLS), c) - 1
            bits = F.pmod(code, F.lit(PACKED)) * COUNT_BITS
            unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)
            return F.struct((code / PACKED).cast("int").alias("word"), bits.alias("bits"), unit.alias("unit"), F.when(i > 0, rare(F.get(chars, i - 1), c)).otherwise(F.lit(0)).alias("pair"))

        return _bound(F.transform(chars, one), slid)

    def slid(own: Column) -> Column:
        def held(counts: Column, x: Column) -> Column:
            return F.call_function("shiftright", F.get(counts, x["word"]), x["bits"]).bitwiseAND(F.lit(31).cast("bigint")).cast("int")

        def step(s: Column, x: Column) -> Column:
            # null before the window is full
            old = F.get(own, s["at"] - window)
            pairs = s["pairs"] + x["pair"] - F.coalesce(F.get(own, s["at"] - window + 1)["pair"], F.lit(0))
            c_new, c_old = held(s["counts"], x), held(s["counts"], old)
            # one enters and one leaves: only their two counts and terms of the sum change
            out = F.coalesce(F.get(gain, c_old - 1) - F.get(gain, c_old), F.lit(0.0))
            same = F.coalesce((x["word"] == old["word"]) & (x["bits"] == old["bits"]), F.lit(False))
            sums = s["sum"] + F.when(same, F.lit(0.0)).otherwise(F.get(gain, c_new + 1) - F.get(gain, c_new) + out)
            counts = F.transform(s["counts"], lambda w, j: w + F.when(j == x["word"], x["unit"]).otherwise(none) - F.when(j == old["word"], old["unit"]).otherwise(none))
            return F.struct((s["at"] + 1).alias("at"), counts.alias("counts"), sums.alias("sum"), pairs.alias("pairs"), s["best"].alias("best"), s["odd"].alias("odd"))

        def judged(s: Column) -> Column:
            now = F.when(s["at"] >= window, F.lit(math.log2(window)) - s["sum"] / window).otherwise(F.lit(0.0))
            return s.withField("best", F.greatest(s["best"], now)).withField("odd", s["odd"] | ((s["pairs"] >= UNCOMMON) & (now >= LEAST_BITS)))

        counts = F.array_repeat(none, -(-len(SYMBOLS) // PACKED))
        start = F.struct(F.lit(0).alias("at"), counts.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("pairs"), F.lit(0.0).alias("best"), F.lit(False).alias("odd"))
        return F.aggregate(own, start, lambda s, x: _bound(step(s, x), judged), lambda s: F.struct(s["best"].alias("best"), s["odd"].alias("odd")))

    nothing = F.struct(F.lit(0.0).alias("best"), F.lit(False).alias("odd"))
    return F.when(F.length(text) >= window, _bound(F.split(text, ""), described)).otherwise(nothing)


def best_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest entropy in bits of a window of text; 0 if it is shorter."""
    return walked(text, window)["best"]


def _run(pairs: int) -> str:
    """A pattern of pairs and one more letters of one case, but for a capital at the start, of which each two are frequent in words."""
    small = "|".join(f"[{x[0].upper()}{x[0]}](?=[{x[1:]}])" for x in FOLLOWING)
    large = "|".join(f"{x[0]}(?=[{x[1:]}])" for x in map(str.upper, FOLLOWING))
    return f"(?:{small}){{{pairs},}}[a-z]|(?:{large}){{{pairs},}}[A-Z]"


def suspicious(text: Column, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED) -> Column:
    """Whether the candidate has a window of its class's entropy beside what the allow-list and words have of it."""
    chosen = None
    for name, pattern, least, least_left in classes:
        own = F.struct(F.lit(float(least)).alias("least"), F.lit(float(least_left)).alias("left"), F.lit(name in ("letters", "word")).alias("lettered"), F.lit(name == "hex").alias("hex"))
        chosen = F.when(text.rlike(pattern), own) if chosen is None else chosen.when(text.rlike(pattern), own)
    known, rest = F.lit(False), text
    for pattern in allowed:
        if pattern.startswith("^"):
            known = known | F.btrim(text, F.lit("/_=-")).rlike(pattern)
        else:
            rest = F.regexp_replace(rest, pattern + ONWARD * pattern.endswith("abcdefghij"), FILL)
    # a path of words is known, but not one with random letters in it
    path = text.rlike("^[A-Za-z/_=-]+$")
    (long_run, long_fill), (run, fill) = RUNS
    joined = lambda t: F.translate(t, "/_-", "===")

    def judged(own: Column) -> Column:
        def told(r: Column) -> Column:
            few = F.when(own["hex"], r).otherwise(F.regexp_replace(r, _run(long_run), long_fill))
            measured = F.when(own["lettered"] | own["hex"], few).otherwise(joined(few))
            left = lambda: walked(joined(F.regexp_replace(r, _run(run), fill)), window)["best"] >= own["left"]
            by_class = lambda x: ((x["best"] >= own["least"]) & ((own["left"] <= 0) | left())) | (own["lettered"] & x["odd"])
            return _bound(walked(measured, window), lambda x: F.when(known, x["odd"]).otherwise(by_class(x)))

        return _bound(rest, told)

    # the cheap tests first: windows are walked only for what they leave
    return F.when((F.length(text) < window) | (known & ~path), F.lit(False)).otherwise(_bound(chosen, judged))


def outside(span: Column, base: Column) -> Column:
    """The parts of a span that no span of base covers, in order."""

    def part(first: Column, end: Column) -> Column:
        match = F.substring(span["match"], first - span["start"] + 1, end - first)
        return F.array(F.struct(first.alias("start"), span["ord"].alias("ord"), end.alias("end"), span["kind"].alias("kind"), match.alias("match")))

    nothing = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,match:string>>")
    met = F.array_sort(F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"])))
    cut = F.aggregate(
        met,
        F.struct(span["start"].alias("at"), nothing.alias("out")),
        lambda s, b: F.struct(F.greatest(s["at"], b["end"]).alias("at"), F.when(b["start"] > s["at"], F.concat(s["out"], part(s["at"], b["start"]))).otherwise(s["out"]).alias("out")),
        lambda s: F.when(s["at"] < span["end"], F.concat(s["out"], part(s["at"], span["end"]))).otherwise(s["out"]),
    )
    return cut


def scan(docs: DataFrame, window: int = WINDOW, allowed=ALLOWED) -> DataFrame:
    """docs with base and spans: array<struct<start,ord,end,kind,match>>, spans with the method's kind entropy too."""
    names = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), unmarked(whole_text()).alias("t"))
    parts = kept.select(
        "row",
        marked_parts(F.col("t"), ASSIGN, F.col("t").rlike("[:=]")).alias("p_assign"),
        marked_parts(F.col("t"), ACCESS, F.col("t").contains("AKIA")).alias("p_access"),
        marked_parts(F.col("t"), HEX, F.col("t").rlike("[0-9a-f]{24}")).alias("p_hex"),
        marked_parts(F.col("t"), CANDIDATE, F.col("t").rlike(CANDIDATE)).alias("p_more"),
    )
    yes = F.lit(True)
    found = parts.select(
        "row",
        F.concat(
            located(F.col("p_assign"), "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
            located(F.col("p_access"), "access", 1, lambda m: yes),
            located(F.col("p_hex"), "hex", 2, lambda m: yes),
        ).alias("base"),
        located(F.col("p_more"), "entropy", 3, lambda m: yes).alias("more"),
    )
    parts = F.flatten(F.transform("more", lambda m: outside(m, F.col("base"))))
    apart = F.filter(parts, lambda m: suspicious(m["match"], window, CLASSES, allowed))
    rest = [c for c in names if c not in ("base", "spans")]
    return found.select(*[F.col(f"row.`{c}`") for c in rest], "base", F.concat("base", apart).alias("spans"))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each union of overlapping spans replaced by mask."""
    done = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, count of each base kind, sha256 of the base spans and all spans as text."""
    counts = [count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
