"""Personal data.

Candidate gradient boosting. High-recall generators propose spans that may overlap: the base patterns, and looser
ones for mail addresses (also spelt out), and for groups of digits. Each candidate has features of its format and its
context, all small integers; boosted trees score it, and each generator has a threshold of its own.

The tables have no labelled spans, so the trees learn from LABELLED generated candidates: written forms that are personal
data (addresses spelt with [at] and dot, phones without a plus or in national writing, card numbers in other
groupings, addresses of machines with a port, social-security numbers) and decoys (versions, dates, times, serial and order numbers, sums of money, card-like numbers
that fail Luhn's test, handles, file names), each behind words of its own or neutral ones. No base rule's verdict is a label. A
candidate's part is drawn by hash of its number: LEARN of FOLDS parts grow the trees, the others calibrate the thresholds: the least score from which
the share of personal data is at least precision.

A candidate that reaches its threshold and overlaps no base span is added; of chosen ones that overlap, mail goes first.

Contract. Null text: empty, no spans. Positions count code points, end exclusive. Base matches are the leftmost
non-overlapping ones per kind; those that fail their test are dropped without a retry. Texts of any length are
scanned whole. Repeated rows give repeated results; an empty table gives none; other columns stay (columns named base
or spans are replaced). Ties in score share a side of the threshold.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import count_of, joined_spans, located, marked_parts, unmarked, whole_text

# The base patterns. Possessive runs and the look-behind change no match (each class ends where the next
# part begins, and a match that could start inside a run starts at its beginning or after the last match), they only
# keep long runs from being tried from every character.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = ("email", "ip", "card", "phone")
# the looser generators
MAIL_LIKE = r"(?i)(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?(?:@|[\[({]at[\])}])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)"
DIGITS = r"(?:\+\x20?)?\(?[0-9](?:[\x20()./:-]{0,3}[0-9]){5,}+"
GENERATORS = ("mail", "digits")
CONTEXT = 24
#: Words before a candidate: for personal data of each kind, and for what is none.
CUES = (
    r"(?i)(order|invoice|serial|version|\bv$|\bv\.|isbn|doi|ref|article|ticket|build|batch|model|part|issue|\bno\b|number|id\b|total|price|sum|usd|eur|[$€£]|sku|lot|page|since|from|between|date|released|at\x20$|on\x20$|chapter|section|table|figure|ratio|score)",
    r"(?i)(card|visa|master|credit|amex|debit|payment)",
    r"(?i)(phone|tel\b|tel\.|call|mobile|cell|fax|dial|ring|whatsapp|reach|sms)",
    r"(?i)(mail|contact|write|reach|send|support|ask)",
    r"(?i)(\bip\b|host|server|address|node|ping|login)",
)
FEATURES = {"kind": 2, "digits": 9, "groups": 6, "first": 6, "last": 6, "luhn": 2, "lead": 4, "plus": 2, "paren": 2, "dots": 4, "colon": 2, "slash": 2, "dash": 3, "space": 3, "at": 3, "suffix": 2, "bytes": 2, "cue": 6}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "it", "nl", "uk", "eu", "us", "ca", "au", "ch", "at", "pl", "se", "jp", "cn", "in", "br")
#: Generated candidates, and of their FOLDS parts those that grow trees.
LABELLED, FOLDS, LEARN = 8_000, 4, 3
ROUNDS, DEPTH, RATE = 40, 4, 0.3
#: A split needs so many candidates on each side.
LEAST_SIDE = 20
PRECISION = 0.98
#: Trees and thresholds, learnt from the generated forms and kept beside this module.
TREES = Path(__file__).with_name("pii_trees.json")
_learnt: dict = {}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.coalesce(term(i), F.lit(0)))
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_card(match: Column) -> Column:
    digits = only_digits(match)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def is_phone(match: Column) -> Column:
    return F.length(only_digits(match)).between(9, 15)


def is_ip(match: Column) -> Column:
    return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def features(m: Column, before: Column, kind: int) -> Column:
    """array<int> of FEATURES of a candidate m of that generator, with the text before it."""
    digits = only_digits(m)
    n = F.length(digits)
    parts = F.filter(F.split(m, "[^0-9]+"), lambda g: F.length(g) > 0)
    cue = F.lit(0)
    # what stands last before the candidate counts most
    for k, pattern in enumerate(CUES):
        cue = F.when(before.rlike(pattern), k + 1).otherwise(cue)
    lead = F.substring(digits, 1, 1)
    names = F.split(F.lower(m), r"[^a-z0-9-]+")
    values = {
        "kind": F.lit(kind),
        "digits": F.when(n < 7, 0).when(n == 7, 1).when(n <= 9, 2).when(n == 10, 3).when(n == 11, 4).when(n == 12, 5).when(n <= 15, 6).when(n == 16, 7).otherwise(8),
        "groups": F.least(F.size(parts), F.lit(5)),
        "first": F.least(F.coalesce(F.length(F.element_at(parts, 1)), F.lit(0)), F.lit(5)) if kind == 0 else F.lit(0),
        "last": F.least(F.coalesce(F.length(F.element_at(parts, -1)), F.lit(0)), F.lit(5)) if kind == 0 else F.lit(0),
        "luhn": F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False)).cast("int"),
        "lead": F.when(lead == "0", 1).when(lead.isin("3", "4", "5", "6"), 2).when(lead.isin("1", "2"), 3).otherwise(0),
        "plus": m.startswith("+").cast("int"),
        "paren": m.contains("(").cast("int"),
        "dots": F.least(_count(m, "."), F.lit(3)),
        "colon": m.contains(":").cast("int"),
        "slash": m.contains("/").cast("int"),
        "dash": F.least(_count(m, "-"), F.lit(2)),
        "space": F.least(_count(m, " "), F.lit(2)),
        "at": F.when(m.contains("@"), 0).when(m.rlike(r"(?i)[\[({]at"), 1).otherwise(2) if kind else F.lit(0),
        "suffix": F.element_at(names, -1).isin(*TOP_DOMAINS).cast("int") if kind else F.lit(0),
        "bytes": (F.size(parts) >= 4).cast("int") * F.forall(F.slice(parts, 1, 4), lambda g: F.coalesce(F.length(g) <= 3, F.lit(False)) & (F.coalesce(g.try_cast("int"), F.lit(999)) <= 255)).cast("int") if kind == 0 else F.lit(0),
        "cue": cue,
    }
    return F.array(*[values[k].cast("int") for k in FEATURES])


def generated(rows: int = LABELLED, seed: int = 7, left_out: tuple[int, ...] = (), only: tuple[int, ...] = ()) -> list[tuple[int, str, int, int, int, int]]:
    """id, text, start and size of a written form in it, the generator it is for, and 1 if it is personal data. left_out and only:
    places of forms that are not, or alone, drawn from, to hold out whole forms."""
    r = random.Random(seed)
    number = lambda size, least=0: str(r.randrange(least, 10**size)).zfill(size)
    byte = lambda: str(r.randrange(256))

    def card(right: bool) -> str:
        body = r.choice("4536") + number(14)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, body)))
        return body + str((-total + (not right) * r.randrange(1, 10)) % 10)

    def grouped(text: str, sign: str) -> str:
        return sign.join(text[i : i + 4] for i in range(0, 16, 4))

    def spelt() -> str:
        who = r.choice(("jo", "anna", "max", "lee", "sales", "info", "k", "dr")) + r.choice((".smith", "", "_w", ".k", "mann", "2"))
        at, dot = r.choice(((" at ", " dot "), (" @ ", "."), *[(a, d) for a in (" [at] ", " (at) ", "[at]", "(at)", " {at} ") for d in (" [dot] ", " (dot) ", ".", "[dot]", " {dot} ")]))
        return who + at + r.choice(("mail", "acme", "corp-x", "uni", "web", "post")) + r.choice(("", "7", "-eu", "dev")) + dot + r.choice(TOP_DOMAINS)

    area = lambda: (number(3, 200), number(3, 200), number(4))
    code = lambda: r.choice(("49", "44", "33", "34", "1"))
    machine = lambda: ".".join(byte() for _ in range(4))
    date = lambda: (str(r.randrange(1970, 2030)), number(2, 1)[-2:], number(2, 1)[-2:])
    clock = lambda: f"{r.randrange(24):02}:{r.randrange(60):02}"
    phones = ("call ", "tel ", "phone: ", "mobile ", "fax ", "reach me at ")
    cards = ("card ", "visa ", "credit card: ", "pay with ", "debit card no ")
    mails = ("mail ", "contact ", "write to ", "e-mail: ", "send it to ")
    hosts = ("server ", "host ", "ip ", "login from ", "ping ")
    others = ("order ", "invoice ", "serial ", "ref ", "ticket ", "isbn ", "id ", "build ", "sku ", "total ", "no ")
    plain = ("", "and ", "the ", "with ", "of ")
    forms = [  # words before it, what is written, generator (1 mail, 0 digits), personal
        (mails + plain, spelt, 1, 1),
        (plain, lambda: r.choice(("icon", "a.b", "x_1")) + r.choice(("@2x.", "@v1.", "@3x.")) + r.choice(("png", "jpg", "svg", "js", "css")), 1, 0),
        (plain, lambda: r.choice(("look", "meet", "stop", "arrive")) + " at " + r.choice(("the", "page", "point", "noon")) + r.choice((".", " dot ")) + r.choice(("then", "figure", "we", "matrix", "plot")), 1, 0),
        (phones + plain, lambda: "({}) {}-{}".format(*area()), 0, 1),
        (phones + plain, lambda: "-".join(area()), 0, 1),
        (("ssn ", "social security number ", "my ssn is ") + plain, lambda: f"{number(3, 100)}-{number(2, 10)}-{number(4, 1000)}", 0, 1),
        (others, lambda: f"{number(3, 100)}-{number(2, 10)}-{number(4, 1000)}", 0, 0),
        (phones + plain, lambda: ".".join(area()), 0, 1),
        (phones, lambda: f"1 ({number(3, 200)}) {number(3, 200)}-{number(4)}", 0, 1),
        (phones, lambda: f"0{number(2, 20)} {number(3, 100)} {number(4)}", 0, 1),
        (phones, lambda: f"0{number(2, 10)}/{number(7, 10**6)}", 0, 1),
        (phones, lambda: f"{r.choice(('00', '+ '))}{code()} {number(3, 200)} {number(7, 10**6)}", 0, 1),
        (cards + plain, lambda: grouped(card(True), r.choice((".", " - ", "/", "  "))), 0, 1),
        (hosts + plain, lambda: f"{machine()}:{number(4, 1000)}", 0, 1),
        (hosts + plain, lambda: f"{machine()}/{r.randrange(8, 33)}", 0, 1),
        (("version ", "v", "release ", "build "), lambda: f"{r.randrange(9)}.{r.randrange(30)}.{r.randrange(99)}.{number(4)}", 0, 0),
        (others, lambda: number(r.choice((7, 9, 10, 11, 12, 14, 16))), 0, 0),
        (plain, lambda: number(r.choice((7, 8, 9, 12))), 0, 0),
        (others + plain + cards + phones, lambda: grouped(card(False), r.choice(("", " ", "-", ".", "/"))), 0, 0),
        (phones + hosts + mails, lambda: number(r.choice((6, 12, 13, 14, 16, 17, 18))), 0, 0),
        (plain, lambda: "-".join(date()) + r.choice(("", " " + clock())), 0, 0),
        (plain, lambda: r.choice("./").join(reversed(date())), 0, 0),
        (plain, lambda: clock() + ":" + number(2), 0, 0),
        (("$", "EUR ", "total ", "price "), lambda: f"{number(3, 100)}.{number(3)}.{number(3)}", 0, 0),
        (plain, lambda: f"{date()[0]} - {date()[0]}", 0, 0),
        (others, lambda: f"978-{r.randrange(10)}-{number(4)}-{number(4)}-{r.randrange(10)}", 0, 0),
        (plain, lambda: " ".join(str(r.randrange(100)) for _ in range(8)), 0, 0),
    ]
    forms = [x for i, x in enumerate(forms) if i not in left_out and (not only or i in only)]
    out = []
    for n in range(rows):
        cues, form, kind, personal = r.choice(forms)
        lead, own = "lorem ipsum dolor sit " + r.choice(cues), form()
        out.append((n, f"{lead}{own} amet", len(lead), len(own), kind, personal))
    return out


def labelled(spark: SparkSession, rows: int = LABELLED, left_out: tuple[int, ...] = ()) -> DataFrame:
    """kind, x, y, part of generated candidates: y is 1 for personal data. Equal on every run."""
    texts = spark.createDataFrame(generated(rows, left_out=left_out), "id int, t string, own int, size int, kind int, y int")
    found = _candidates(texts.select(F.struct("id", "own", "size", "kind", "y").alias("row"), "t"))
    each = found.select("row", F.explode("candidates").alias("c"))
    # candidates of the generator that the form is for, which cover most of it
    meant = (F.col("c.x")[0] == F.col("row.kind")) & (F.col("c.span.start") <= F.col("row.own") + 1) & (F.col("c.span.end") >= F.col("row.own") + 0.7 * F.col("row.size"))
    part = F.pmod(F.xxhash64("row.id"), F.lit(FOLDS))
    return each.where(meant).select("row.kind", "c.x", "row.y", part.alias("part"))


def _candidates(rows: DataFrame) -> DataFrame:
    """rows (row, t, and others) with candidates: array of (span, x) of both generators."""
    others, t = [c for c in rows.columns if c != "t"], F.col("t")
    low = F.lower(t)
    mail = t.contains("@") | low.contains(" dot ") | low.contains("at]") | low.contains("at)") | low.contains("at}")
    parts = rows.select(*others, "t", *[marked_parts(F.col("t"), p, some).alias(f"g{i}") for i, (p, some) in enumerate(((MAIL_LIKE, mail), (DIGITS, t.rlike("[0-9]"))))])
    yes = lambda m: F.lit(True)
    spans = parts.select(*others, "t", *[located(F.col(f"g{i}"), kind, 4 + i, yes, CONTEXT).alias(kind) for i, kind in enumerate(GENERATORS)])

    def described(kind: str, number: int) -> Column:
        return F.transform(kind, lambda s: F.struct(F.struct(*[s[n].alias(n) for n in ("start", "ord", "end", "kind", "match")]).alias("span"), features(s["match"], s["before"], number).alias("x")))

    return spans.select(*others, "t", F.concat(described("mail", 1), described("digits", 0)).alias("candidates"))


def proposals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns of docs to keep), base (spans of the base rules) and candidates (span, x: its features)."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), unmarked(whole_text()).alias("t"))
    t = F.col("t")
    some = (t.contains("@"), t.rlike(r"[0-9]\.[0-9]"), t.rlike("[0-9][\x20-]?[0-9]"), t.contains("+"))
    parts = kept.select("row", "t", *[marked_parts(t, p, own).alias(f"p{i}") for i, (p, own) in enumerate(zip((EMAIL, IP, CARD, PHONE), some, strict=True))])
    yes = F.lit(True)
    base = F.concat(
        located(F.col("p0"), "email", 0, lambda m: yes),
        located(F.col("p1"), "ip", 1, is_ip),
        located(F.col("p2"), "card", 2, is_card),
        located(F.col("p3"), "phone", 3, is_phone),
    )
    return _candidates(parts.select("row", base.alias("base"), "t")).drop("t")


def boosted(cells: list[tuple[list[int], float, float]], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> list:
    """Trees of logistic boosting over cells (x, rows, rows with y = 1). A tree is (feature, cut, left, right) with x <= cut
    to the left, or a leaf's value. Splits are found on sums per value of a feature."""
    import numpy as np

    x = np.array([c[0] for c in cells], np.int64)
    n, y = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    f = np.zeros(len(cells))
    sizes = list(FEATURES.values())

    def grow(own, g, h, left):
        sg, sh = g[own].sum(), h[own].sum()
        best = (1e-6, None, None)
        for j, values in enumerate(sizes if left else []):
            at = x[own, j]
            lg, lh, ln = (np.cumsum(np.bincount(at, v[own], values))[:-1] for v in (g, h, n))
            gain = lg**2 / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg**2 / (sh + 1)
            gain[np.minimum(ln, n[own].sum() - ln) < LEAST_SIDE] = 0
            if len(gain) and gain.max() > best[0] + 1e-9:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            return float(rate * sg / (sh + 1.0))
        _, j, cut = best
        return (j, cut, grow(own[x[own, j] <= cut], g, h, left - 1), grow(own[x[own, j] > cut], g, h, left - 1))

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = grow(np.arange(len(cells)), y - n * p, n * p * (1 - p), depth)
        trees.append(tree)
        f = f + np.array([value(tree, c[0]) for c in cells])
    return trees


def value(tree, x: list[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def learn(candidates: DataFrame, precision: float = PRECISION, rounds: int = ROUNDS) -> tuple[list, dict[str, float]]:
    """Trees, and for each generator the least score from which the share of y = 1 among the calibrating candidates is at
    least precision (infinite without any). candidates: kind, x, y, part.

    The driver gets one row per combination of features that occurs: fewer than generated candidates, whatever the corpus.
    """
    rows = candidates.groupBy("kind", "x", (F.col("part") < LEARN).alias("learns")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    grown = sorted((list(r["x"]), float(r["n"]), float(r["y"])) for r in rows if r["learns"])
    if not 0 < sum(c[2] for c in grown) < sum(c[1] for c in grown):
        return [], dict.fromkeys(GENERATORS, math.inf)
    trees, cuts = boosted(grown, rounds), {}
    for kind, name in ((1, "mail"), (0, "digits")):
        held = sorted(((sum(value(t, r["x"]) for t in trees), r["n"], r["y"]) for r in rows if not r["learns"] and r["kind"] == kind), reverse=True)
        cut, seen, good = math.inf, 0.0, 0.0
        for i, (s, own, hits) in enumerate(held):
            seen, good = seen + own, good + hits
            # equal scores go to one side
            if good >= precision * seen and (i + 1 == len(held) or held[i + 1][0] < s - 1e-9):
                cut = s - 1e-6
        # never below even odds, which is what the score says where few of the held-out rows stand
        cuts[name] = max(cut, 0.0)
    return trees, cuts


def _key(precision: float) -> str:
    """Names all that the trees depend on but for the code of the features: the generated texts, sizes and settings."""
    told = [generated(), FEATURES, CUES, TOP_DOMAINS, CONTEXT, MAIL_LIKE, DIGITS, LABELLED, FOLDS, LEARN, ROUNDS, DEPTH, RATE, LEAST_SIDE, precision]
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def learnt(spark: SparkSession, precision: float = PRECISION) -> tuple[list, dict[str, float]]:
    """What learn() gives for labelled(): read from TREES if that was written for the same forms and settings, else learnt now, once
    for each driver. `python -m postmill.llm.pii` writes TREES anew; a test holds it against learn()."""
    key = _key(precision)
    if key not in _learnt:
        kept = json.loads(TREES.read_text()) if TREES.exists() else {}
        if kept.get("key") == key:
            tree = lambda x: (x[0], x[1], tree(x[2]), tree(x[3])) if isinstance(x, list) else x
            _learnt[key] = [tree(x) for x in kept["trees"]], kept["cuts"]
        else:
            _learnt[key] = learn(labelled(spark), precision)
    return _learnt[key]


def score(x: Column, trees: list) -> Column:
    def expression(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        j, cut, left, right = tree
        return F.when(x[j] <= cut, expression(left)).otherwise(expression(right))

    total = F.lit(0.0)
    for tree in trees:
        total = total + expression(tree)
    return total


def scan(docs: DataFrame, precision: float = PRECISION, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns named in keep) with base and spans: array<struct<start,ord,end,kind,match>>, spans with the
    method's kinds mail and digits."""
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    trees, cuts = learnt(docs.sparkSession, precision)
    found = proposals(docs, rest)

    def over(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def chosen(c: Column) -> Column:
        cut = F.when(c["span"]["kind"] == "mail", F.lit(cuts["mail"])).otherwise(F.lit(cuts["digits"]))
        # the trees last: they are asked only for what no base span covers
        return F.when(F.exists("base", lambda b: over(b, c["span"])), F.lit(False)).otherwise(score(c["x"], trees) >= cut)

    more = F.when(F.size("candidates") > 0, F.transform(F.filter("candidates", chosen), lambda c: c["span"])).otherwise(F.transform("candidates", lambda c: c["span"]))
    picked = found.select("row", "base", more.alias("more"))
    mail = F.filter("more", lambda s: s["kind"] == "mail")
    apart = F.filter("more", lambda s: (s["kind"] == "mail") | ~F.exists(mail, lambda m: over(s, m)))
    return picked.select(*[F.col(f"row.`{c}`") for c in rest], "base", F.concat("base", apart).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, count of each base kind, sha256 of the base spans, all spans as text and their number."""
    counts = [count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


if __name__ == "__main__":
    own = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
    grown, limits = learn(labelled(own))
    TREES.write_text(json.dumps({"key": _key(PRECISION), "cuts": limits, "trees": grown}, indent=None, separators=(",", ":")) + "\n")
    own.stop()
