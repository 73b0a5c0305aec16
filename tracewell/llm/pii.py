"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base spans come from four fixed patterns with their checks. Beside them, loose generators propose overlapping spans; each
candidate gets format features (digits, groups, separators, checksums) and context features (words before it, the
characters around it). Boosted trees become one SQL expression; they are fitted on the driver on two bounded sets: the
candidates of sampled documents, right where a base span has their very ends, and those of generated snippets, which
hold forms that no base pattern knows (an address spelled with "(at)" and "dot", an IPv6 address, a phone number without
a plus) beside look-alikes (times, dates, versions, ratios, order numbers), right where the snippet put personal data.
So spans that the base patterns lose are judged by how they look. A threshold for each generator, calibrated on rows
that the trees did not see, selects the spans that are added. Executors run built-in expressions only.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Possessive forms and look-behinds only keep a failing match from being tried again
# inside its own run; \G stands for a start right after the last match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"  # a maximal run of fewer digits is no card
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
KINDS = ("email", "ip", "card", "phone")

#: Loose generators: name, what the text must hold, pattern. Their proposals overlap; most are no base span.
GENERATORS = (
    ("email_like", r"(?i)\bat\b|@", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[ ]?(?:@|\(at\)|\[at\]|\{at\})[ ]?[A-Za-z0-9-]{1,63}+(?:[ ]?(?:\.|\(dot\)|\[dot\]|\{dot\})[ ]?[A-Za-z0-9-]{1,63}+)++"),
    ("phone_like", r"[0-9]", r"(?<![A-Za-z0-9])\+?\(?[0-9]{1,4}\)?(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![A-Za-z0-9])"),
    ("card_like", r"[0-9]", r"(?<![A-Za-z0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![A-Za-z0-9])"),
    ("digits_like", r"[0-9]", r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){5,}+(?![A-Za-z0-9])"),
    ("address_like", r"[0-9]", r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:[.:,][0-9]{1,3}){2,4}(?![A-Za-z0-9])"),
    ("address6_like", r":", r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}+:){1,7}+(?::?[0-9A-Fa-f]{1,4}+)++(?![A-Za-z0-9:])"),
)
#: Context words, before or inside the 24 code points that come before a span.
CUES = {"cue_phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell)", "cue_card": r"(?i)\b(?:card|visa|credit|iban|account|acct)", "cue_mail": r"(?i)\b(?:e-?mail|contact|write)", "cue_host": r"(?i)\b(?:ip|host|address|server)"}
FEATURES = ("length", "digits", "groups", "blanks", "dots", "dashes", "plus", "ats", "letters", "luhn", "after_letter", *CUES)
SPAN = "struct<kind:string,start:int,end:int,text:string>"


def located(text: Column, pattern: str, holds: Column, kind: str) -> Column:
    """Leftmost matches as spans in code points: lengths of the pieces between matches, and of the matches, add up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pair = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("found"))
    start = lambda acc, x: acc["at"] + F.length(x["piece"])
    step = lambda acc, x: F.struct((start(acc, x) + F.length(F.coalesce(x["found"], F.lit("")))).alias("at"), F.when(x["found"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(F.lit(kind).alias("kind"), start(acc, x).alias("start"), (start(acc, x) + F.length(x["found"])).alias("end"), x["found"].alias("text"))))).alias("spans"))
    empty = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.when(holds, F.aggregate(pair, zero, step)["spans"]).otherwise(empty)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The checksum of a string of digits holds; false for none and, as substring walks the string, for more than 40."""
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).try_cast("int")  # noqa: E731  no digit at all gives '' and so null
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), lambda s, i: s + F.coalesce(F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)), F.lit(0)))
    return F.when(F.length(digits).between(1, 40), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    """Span arrays of the four kinds, checked."""
    digit = text.rlike("[0-9]")
    email = located(text, EMAIL, F.contains(text, F.lit("@")), "email")
    ip = F.filter(located(text, IP, digit & F.contains(text, F.lit(".")), "ip"), lambda s: s["text"].rlike(OCTETS))
    card = F.filter(located(text, CARD, digit, "card"), lambda s: F.length(digits_of(s["text"])).between(16, 19) & luhn(digits_of(s["text"])))
    phone = F.filter(located(text, PHONE, F.contains(text, F.lit("+")), "phone"), lambda s: F.length(digits_of(s["text"])).between(8, 15))
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def candidates(text: Column) -> Column:
    """All generators' proposals; they may overlap each other and base spans."""
    return F.concat(*(located(text, pattern, text.rlike(holds), name) for name, holds, pattern in GENERATORS))


def features(text: Column, s: Column) -> Column:
    """Numbers about one candidate, as an array<double> in the order of FEATURES."""
    t, before = s["text"], F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"]))
    left = lambda chars: F.length(t) - F.length(F.regexp_replace(t, chars, ""))
    flag = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
    values = [F.length(t), left("[0-9]"), F.size(F.split(t, "[^0-9A-Za-z]+")), left(" "), left("[.]"), left("-"), left("[+]"), left("@"), left("[A-Za-z]"), flag(luhn(digits_of(t))), flag(before.rlike(r"\p{L}[ ]?$")), *(flag(before.rlike(cue)) for cue in CUES.values())]
    return F.array(*(v.cast("double") for v in values))


@dataclass
class Tree:
    feature: int
    cut: float
    low: float | Tree = 0.0
    high: float | Tree = 0.0

    def value(self, x: list[float]) -> float:
        side = self.low if x[self.feature] <= self.cut else self.high
        return side.value(x) if isinstance(side, Tree) else side

    def sql(self, x: Column) -> Column:
        part = lambda side: side.sql(x) if isinstance(side, Tree) else F.lit(float(side))
        return F.when(x[self.feature] <= self.cut, part(self.low)).otherwise(part(self.high))


@dataclass
class Boosted:
    """Sum of trees, and the score from which on a generator's candidates are taken."""

    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def raw(self, x: list[float]) -> float:
        return self.start + sum(t.value(x) for t in self.trees)

    def sql(self, x: Column) -> Column:
        return reduce(lambda a, t: a + t.sql(x), self.trees, F.lit(self.start))


def _split(rows: list[int], x: list[list[float]], g: list[float], h: list[float], depth: int, rate: float) -> float | Tree:
    gain = lambda a, b: a * a / (b + 1.0)
    sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
    best = (1e-6, None)
    for f in range(len(FEATURES)) if depth else ():
        at: dict[float, list[float]] = {}
        for i in rows:
            s = at.setdefault(x[i][f], [0.0, 0.0])
            s[0] += g[i]
            s[1] += h[i]
        lg = lh = 0.0
        for v in sorted(at)[:-1]:
            lg, lh = lg + at[v][0], lh + at[v][1]
            if (won := gain(lg, lh) + gain(sg - lg, sh - lh) - gain(sg, sh)) > best[0]:
                best = (won, (f, v))
    if best[1] is None:
        return rate * sg / (sh + 1.0)
    f, v = best[1]
    return Tree(f, v, _split([i for i in rows if x[i][f] <= v], x, g, h, depth - 1, rate), _split([i for i in rows if x[i][f] > v], x, g, h, depth - 1, rate))


def boost(x: list[list[float]], y: list[int], names: list[str], rounds: int = 20, depth: int = 3, rate: float = 0.3, precision: float = 0.95, seed: int = 3) -> Boosted:
    """Newton boosting of the logistic loss; every third row is held out, and each generator's threshold is the lowest score at which its held-out candidates are right in `precision` of cases."""
    order = random.Random(seed).sample(range(len(y)), len(y))
    held, used = order[::3], [i for k, i in enumerate(order) if k % 3]
    positive = sum(y[i] for i in used)
    if not positive or positive == len(used):
        return Boosted()
    model = Boosted(math.log(positive / (len(used) - positive)))
    score = [model.start] * len(y)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        tree = _split(used, x, [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p], depth, rate)
        if not isinstance(tree, Tree):
            break
        model.trees.append(tree)
        score = [s + tree.value(r) for s, r in zip(score, x)]
    for name in set(names):
        right = total = 0
        ranked = sorted(((score[i], y[i]) for i in held if names[i] == name), reverse=True)
        for k, (s, hit) in enumerate(ranked):
            right, total = right + hit, total + 1
            if right >= precision * total and right >= 5 and (k + 1 == len(ranked) or ranked[k + 1][0] < s):
                model.thresholds[name] = s
    return model


# Fixed values of the generated snippets.
_LOCAL = ("anna.berg", "j_smith", "maria", "info", "k.lee+news", "tom99", "sales-eu", "pierre.dupont", "office", "r2d2")
_HOST = ("example", "mail", "corp", "uni-bonn", "acme", "blog", "post24", "web")
_TLD = ("com", "org", "net", "de", "fr", "es", "co.uk", "io")
_CUE_MAIL = ("mail me at ", "contact: ", "e-mail ", "write to ", "", "reach us: ", "author ")
_CUE_PHONE = ("call ", "tel. ", "phone: ", "mobile ", "fax ", "", "my number is ")
_CUE_HOST = ("server ", "host ", "from address ", "ip ", "", "ping ", "peer ")
_TAIL = (" now.", " please", ", thanks", "", ". The rest follows", " and more", "\n")


def snippets(n: int = 1_200, seed: int = 17) -> list[tuple[str, int, int, str]]:
    """(text, start, end, generator): generated sentences; generator is empty and the ends are 0 where nothing personal is in them."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda lo, hi: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(lo, hi)))

    def mail() -> str:
        at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "."), ("{at}", "{dot}"), (" [at] ", " [dot] ")))
        return rng.choice(_LOCAL) + at + rng.choice(_HOST) + dot + rng.choice(_TLD).replace(".", dot)

    def phone() -> str:
        a, b, c, sep = rng.randint(200, 989), rng.randint(200, 999), digits(4), rng.choice("-. ")
        return rng.choice((f"({a}) {b}-{c}", f"{a}{sep}{b}{sep}{c}", f"0{a} {b} {c}", f"1-{a}-{b}-{c}"))

    def address6() -> str:
        return ":".join(hexes(1, 4) for _ in range(8)) if rng.random() < 0.6 else ":".join(("fe80", "", hexes(1, 4), hexes(2, 4), hexes(2, 4), hexes(1, 4)))

    def nothing() -> str:
        h, m, s = rng.randint(0, 23), digits(2), digits(2)
        return rng.choice((f"{h}:{m}:{s}", f"{rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}", f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", f"order {digits(8)}", f"page {digits(3)} of {digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"we met at noon. so {digits(2)} {digits(3)}", f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}", f"{rng.randint(1, 9)},{digits(3)},{digits(3)}", f"id {digits(12)}", f"10.{digits(2)}.{digits(4)}", f"{digits(4)} {digits(4)}"))

    out = []
    for k in range(n):
        kind, cues, make = (("email_like", _CUE_MAIL, mail), ("phone_like", _CUE_PHONE, phone), ("address6_like", _CUE_HOST, address6), ("", (*_CUE_MAIL, *_CUE_PHONE, *_CUE_HOST, "at ", "on ", "see "), nothing))[k % 4]
        before = f"{rng.choice(('The', 'A', 'Und', 'Le', 'Para', 'Please'))} {rng.choice(_HOST)} {rng.choice(cues)}"
        what = make()
        out.append((before + what + rng.choice(_TAIL), len(before) if kind else 0, len(before) + len(what) if kind else 0, kind))
    return out


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns(base_spans(F.col("text"))).withColumn("base", F.concat(*KINDS))


def train(docs: DataFrame, sample: int = 4_000, most: int = 40_000, id_col: str = "doc_id", text_col: str = "text", **boosting) -> Boosted:
    """Fit on the candidates of about `sample` documents, `most` of them at most, drawn by hashes, and of the snippets.

    Both numbers are documented bounds: however long or often repeated a drawn document is, its distinct candidates count
    once and no more than `most` come to the driver.
    """
    n = docs.count()
    drawn = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(9)), F.lit(1 << 30)) < F.lit(min(1.0, sample / max(1, n))) * (1 << 30))
    c = F.col("candidate")
    rows = _prepared(drawn, id_col, text_col).withColumn("candidate", F.explode(candidates(F.col("text"))))
    rows = rows.select(c["kind"].alias("kind"), features(F.col("text"), c).alias("x"), F.exists("base", lambda b: (b["start"] == c["start"]) & (b["end"] == c["end"])).alias("y"), "doc_id", c["start"].alias("at"))
    rows = rows.distinct().withColumn("order", F.xxhash64("kind", "doc_id", "at", "x")).orderBy("order", "kind", "doc_id", "at", "x", "y").limit(most)
    made = docs.sparkSession.createDataFrame(snippets(), "text string, lo int, hi int, right string")
    made = made.select("*", F.explode(candidates(F.col("text"))).alias("candidate"))
    made = made.select(c["kind"].alias("kind"), features(F.col("text"), c).alias("x"), ((c["start"] == F.col("lo")) & (c["end"] == F.col("hi")) & (c["kind"] == F.col("right"))).alias("y"))
    got = sorted((r["kind"], list(r["x"]), int(r["y"])) for part in (rows, made) for r in part.collect())
    return boost([x for _, x, _ in got], [y for _, _, y in got], [k for k, _, _ in got], **boosting)


def _annotated(rows: DataFrame, model: Boosted) -> DataFrame:
    """rows (text and the base spans) with `added`: the candidates that the model selects and that overlap no base span."""
    if not model.thresholds:
        return rows.withColumn("added", F.array().cast(f"array<{SPAN}>"))
    rows = rows.withColumn("candidate", candidates(F.col("text")))
    least = F.create_map(*(F.lit(v) for k, t in sorted(model.thresholds.items()) for v in (k, float(t) - 1e-9)))
    free = F.filter("candidate", lambda c: ~F.exists("base", lambda b: overlaps(b, c)) & F.array_contains(F.array(*map(F.lit, sorted(model.thresholds))), c["kind"]))
    # The features stand in a struct, so that every tree reads them and none computes them again.
    rows = rows.withColumn("free", free).withColumn("scored", F.transform("free", lambda c: F.struct(c.alias("c"), features(F.col("text"), c).alias("x"))))
    chosen = F.filter("scored", lambda s: model.sql(s["x"]) >= F.element_at(least, s["c"]["kind"]))
    return rows.withColumn("added", F.array_sort(F.transform(chosen, lambda s: s["c"]))).drop("candidate", "free", "scored")


def find_spans(docs: DataFrame, model: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """doc_id, text, the arrays email, ip, card, phone (base spans), base (all four), and added: what the model selects beside them."""
    model = model or train(docs, id_col=id_col, text_col=text_col, **training)
    return _annotated(_prepared(docs, id_col, text_col), model)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, model: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """Counts and digest of the base spans of every whole text, and all spans by kind (base kinds first), then start.

    Null and empty texts have no spans (the digest is that of the empty string). Null ids and repeated rows pass through,
    a row each; an empty table gives an empty result; other columns are not read. Base spans of different kinds may
    overlap; added spans overlap no base span. No shuffle. The generators' parts are bounded (64 characters of a local
    part, 63 of a label, 7 leading groups of an IPv6 address): longer ones are proposed in part or not at all, which
    concerns added spans only.
    """
    rows = find_spans(docs, model, id_col, text_col, **training)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, model: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """docs with every span that find_pii lists replaced by its kind in brackets; overlapping spans give one replacement.

    All columns of docs stay, in order, whatever their names; null, empty and blank texts stay as they are. Null ids and
    repeated rows pass through, a row each; an empty table gives an empty result.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col, **training)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, F.col(text_col).alias("text")).select("_row", F.coalesce("text", F.lit("")).alias("text")).withColumns(base_spans(F.col("text"))).withColumn("base", F.concat(*KINDS))
    by_start = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = _annotated(rows, model).withColumn("spans", by_start)
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out")))
    folded = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    new = F.when(F.col("_row")[text_col].isNotNull(), F.when(F.size("spans") > 0, folded).otherwise(F.col("text")))
    return found.withColumn("_new", new).select(*(F.col("_new").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
