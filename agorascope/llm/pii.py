"""Personal data by weak supervision, in DataFrame functions only.

Base spans are fixed patterns (email, ip, card, phone). Further candidates are judged: long tokens that mix signs with
digits (secret), numbers in the forms of identity papers and accounts (identifier), and dates (birth). Labelers vote for,
against or not at all: known shapes (regex), a gazetteer of words that announce the kind, the context right before (an
assignment or colon is for it, plain words that announce nothing are against it), the mix of a candidate's characters, and
its form as a plain number or word. The votes' patterns, counted over all documents, are a table of bounded size; on it
expectation-maximisation estimates each labeler's reliability for each kind without labels, and its posteriors train the
final span classifier, a logistic regression over kind, votes and length. Candidates with a probability of at least 0.5
become spans of their kind; base spans always stay, and candidates that touch one are none.

Positions: a pattern's matches and the texts between them give the starts as running sums, in code points. Patterns
are written possessively and only start where a run of their first characters starts, which finds the same matches and
stays linear on long runs.

Scale: two passes over the texts, no shuffle but of the votes' counts; the driver gets at most 3^6 * 4 counts a kind.

Edge cases: a null text is empty; any characters may occur; a text of any length is searched whole; equal rows give
equal results; without candidates no classifier is trained and only base spans remain; input columns called like the
added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import covered

# The base patterns' kinds in their order, patterns, and a sign that each match holds.
LOCAL = "A-Za-z0-9._%+-"
KINDS = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: The judged kinds' patterns, and the words that announce each.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*+[0-9])[A-Za-z0-9_/-]{8,}+",
    "identifier": r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}|[A-Z]{1,2}[0-9]{6,9})(?![A-Za-z0-9-])",
    "birth": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2})(?![0-9/-])",
}
GAZETTEER = {
    "secret": ["password", "passwd", "passphrase", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth", "credential", "bearer", "private_key"],
    "identifier": ["ssn", "social security", "social security number", "passport", "passport no", "iban", "national id", "ausweis", "reisepass", "passeport", "pasaporte", "dni", "nif", "tax id", "licence no", "license no"],
    "birth": ["born", "born on", "birth", "date of birth", "dob", "birthday", "geboren", "geboren am", "geburtsdatum", "né le", "née le", "naissance", "nacido", "nacida", "nacimiento"],
}
LABELERS = ("shape", "gazetteer", "context", "mix", "number", "wordlike")
BLOCK = 4096
LENGTHS = (12, 18, 28)  # upper limits of the length classes
ADDED = (*(f"n_{k}" for k in [*KINDS, *CANDIDATES]), "n_spans", "base_sha256", "spans")


def found(df: DataFrame, name: str, text: Column, pattern: str, sign: str | None) -> DataFrame:
    """Adds ``name``: for each match struct(s: start, e: end, x: the match, before: up to 24 characters of the text between)."""
    here = text.contains(sign) if sign else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_m", F.when(here, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    parts = F.transform(F.col(f"{name}_m"), lambda x, i: F.struct(F.length(F.get(F.col(f"{name}_g"), i)).alias("gap"), x.alias("x"), F.substring(F.get(F.col(f"{name}_g"), i), -24, 24).alias("before")))
    df = df.withColumn(f"{name}_p", parts)
    df = df.withColumn(f"{name}_e", running(F.col(f"{name}_p"), lambda at, p: at + p["gap"] + F.length(p["x"])))
    span = lambda p, i: F.struct((F.get(F.col(f"{name}_e"), i) - F.length(p["x"])).alias("s"), F.get(F.col(f"{name}_e"), i).alias("e"), p["x"].alias("x"), p["before"].alias("before"))
    return df.withColumn(name, F.transform(f"{name}_p", span)).drop(f"{name}_m", f"{name}_g", f"{name}_p", f"{name}_e")


def running(parts: Column, step) -> Column:
    """The states of a fold that starts from 0, one after each part of a named column. Arrays grow by copying, so blocks of 256 states are
    built by themselves and put together: the work stays near linear in the number of parts."""
    none = F.array().cast("array<int>")

    def add(a: Column, p: Column) -> Column:
        after = step(a["at"], p)
        return F.struct(after.alias("at"), F.concat(a["list"], F.array(after)).alias("list"))

    def block(a: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(parts, b * 256 + 1, 256), F.struct(a["at"].alias("at"), none.alias("list")), add)
        return F.struct(inner["at"].alias("at"), F.concat(a["lists"], F.array(inner["list"])).alias("lists"))

    blocks = F.sequence(F.lit(0), F.ceil(F.size(parts) / 256).cast("int") - 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("lists"))
    return F.when(F.size(parts) == 0, none).otherwise(F.aggregate(blocks, start, block, lambda a: F.flatten(a["lists"])))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    signs = F.transform(F.split(F.reverse(digits(x)), "", -1), lambda c: F.when(c == "", 0).otherwise(c.cast("int")))
    doubled = F.transform(signs, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def checker(kind: str):
    return lambda s: valid(kind, s["x"])


def valid(kind: str, x: Column) -> Column:
    n = F.length(digits(x))
    if kind == "ip":
        # longer parts than four digits are above 255 unless they are zeros
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return n.between(16, 19) & luhn(x)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds __p_<kind> for each base kind, and for each judged kind the candidates that touch no base span."""
    df = docs.withColumn("__p_text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__p_text")
    for kind, (pattern, sign) in KINDS.items():
        df = found(df, f"__p_{kind}", t, pattern, sign)
        df = df.withColumn(f"__p_{kind}", F.filter(F.col(f"__p_{kind}"), checker(kind)))
    for kind, pattern in CANDIDATES.items():
        df = found(df, f"__p_{kind}", t, pattern, None)
    df = df.withColumn("__p_base", F.concat(*[F.transform(f"__p_{k}", lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"))) for k in KINDS]))
    # base spans by the blocks of characters that they lie in, so that a candidate meets the few around it only
    spread = F.flatten(F.transform("__p_base", lambda b: F.transform(F.sequence(F.floor(b["s"] / BLOCK), F.floor((b["e"] - 1) / BLOCK)), lambda k: F.struct(k.alias("k"), b["s"].alias("s"), b["e"].alias("e")))))
    df = df.withColumn("__p_order", F.array_sort(spread))
    after = lambda i: F.coalesce(F.get(F.col("__p_order"), i + 1)["k"], F.lit(-1).cast("long"))
    df = df.withColumn("__p_ends", F.filter(F.transform("__p_order", lambda x, i: F.when(after(i) != x["k"], i + 1)), lambda i: i.isNotNull()))
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(F.col("__p_ends"), j - 1))
    part = lambda e, j: F.transform(F.slice(F.col("__p_order"), start(j) + 1, e - start(j)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    df = df.withColumn("__p_near", F.map_from_arrays(F.transform("__p_ends", lambda e: F.get(F.col("__p_order"), e - 1)["k"]), F.transform("__p_ends", part)))
    here = lambda k: F.coalesce(F.try_element_at(F.col("__p_near"), k), F.array().cast("array<struct<s:int,e:int>>"))
    touches = lambda c: F.exists(F.flatten(F.transform(F.sequence(F.floor(c["s"] / BLOCK), F.floor((c["e"] - 1) / BLOCK)), here)), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    # together: what one place alone reads, Spark would write out in it, and so work out anew for each candidate
    return df.withColumns({f"__p_{kind}": F.filter(f"__p_{kind}", lambda c: ~touches(c)) for kind in CANDIDATES})


def votes(c: Column, kind: str) -> list[Column]:
    """0: against, 1: no vote, 2: for; in the order of LABELERS."""
    x, before = c["x"], F.lower(c["before"])
    letters, n = F.length(F.regexp_replace(x, "[^A-Za-z]", "")), F.length(digits(x))
    announced = before.rlike(r"(?:" + "|".join(GAZETTEER[kind]) + r")[\"']?\.?\s*(?:[=:#]|is|was)?\s*[\"']?$")
    gazetteer = F.when(announced, 2).otherwise(1)
    context = F.when(before.rlike(r"[=:#]\s*[\"']?$"), 2).when(~announced & before.rlike(r"\p{L}[.,;!?]?\s+$"), 0).otherwise(1)
    if kind == "secret":
        shape = F.when(x.rlike(r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,}|[0-9A-F]{16,}|gh[a-z]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,})$") & (letters > 0), 2).otherwise(1)
        mix = F.when((letters >= 3) & (n >= 3) & (F.length(x) >= 12), 2).when((letters == 0) | (n <= 1), 0).otherwise(1)
        number = F.when(letters == 0, 0).otherwise(1)
        wordlike = F.when(x.rlike(r"[a-z]{7,}|^[A-Za-z]+[0-9]{1,4}$"), 0).otherwise(1)
    elif kind == "identifier":
        shape = F.when(x.rlike(r"^(?:000|666|9[0-9]{2})-|^[0-9]{3}-00-|-0000$"), 0).otherwise(1)
        mix = F.when(x.rlike(r"^[A-Z]{2}[0-9]{2}") & (n >= 10), 2).otherwise(1)
        number, wordlike = F.lit(1), F.lit(1)
    else:
        parts = F.split(x, "[./-]")
        month = F.when(F.length(parts[0]) == 4, F.least(parts[1].cast("int"), parts[2].cast("int"))).otherwise(F.least(parts[0].cast("int"), parts[1].cast("int")))
        shape = F.when(~month.between(1, 12), 0).otherwise(1)
        mix, number, wordlike = F.lit(1), F.lit(1), F.lit(1)
    return [v.cast("int") for v in (shape, gazetteer, context, mix, number, wordlike)]


def length_class(c: Column) -> Column:
    n = F.length(c["x"])
    out = F.lit(len(LENGTHS))
    for k in reversed(range(len(LENGTHS))):
        out = F.when(n <= LENGTHS[k], k).otherwise(out)
    return out


def estimate(cells: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> list[float]:
    """EM over (votes, number): for each cell the posterior that its candidates are secrets. A labeler's reliability is
    that of the votes it casts; not to vote is no evidence. A weak prior holds labelers for rather right than wrong."""
    # to begin with, the sum of votes
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v - 1 for v in vote))) for vote, _ in cells]
    for _ in range(rounds):
        mass = [1e-9 + sum((p if y else 1 - p) * n for p, (_, n) in zip(post, cells)) for y in (0, 1)]
        rates = []
        for k in range(len(LABELERS)):
            cast = [[sum((p if y else 1 - p) * n for p, (vote, n) in zip(post, cells) if vote[k] == v) for v in (0, 2)] for y in (0, 1)]
            # as if each labeler had been seen right eight times of ten
            rates.append([{v: ((8 if (v == 2) == bool(y) else 2) + c) / (10 + sum(own)) for v, c in zip((0, 2), own)} for y, own in enumerate(cast)])
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        post = []
        for vote, _ in cells:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[k][1][v] / rates[k][0][v]) for k, v in enumerate(vote) if v != 1)
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return post


Model = tuple[dict[str, float], dict[str, list[list[float]]], list[float]]


def fit(cells: list[tuple[str, tuple[int, ...], int, int]], steps: int = 400) -> Model:
    """The span classifier (bias by kind, weights by kind, labeler and vote, weight by length class) from (kind, votes,
    length class, number)."""
    kinds = sorted({k for k, *_ in cells})
    post: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in kinds:
        by_vote: dict[tuple[int, ...], int] = {}
        for k, vote, _, n in cells:
            if k == kind:
                by_vote[vote] = by_vote.get(vote, 0) + n
        order = sorted(by_vote)
        post.update(zip([(kind, v) for v in order], estimate([(v, by_vote[v]) for v in order])))
    bias = dict.fromkeys(kinds, 0.0)
    w = {k: [[0.0] * 3 for _ in LABELERS] for k in kinds}
    lw = [0.0] * (len(LENGTHS) + 1)
    total = {k: sum(n for kind, _, _, n in cells if kind == k) for k in kinds}  # a rare kind counts as much as a common one
    for _ in range(steps):
        gb, gw, gl = dict.fromkeys(kinds, 0.0), {k: [[0.0] * 3 for _ in LABELERS] for k in kinds}, [0.0] * len(lw)
        for kind, vote, size, n in cells:
            z = bias[kind] + lw[size] + sum(w[kind][k][v] for k, v in enumerate(vote))
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - post[kind, vote]) * n / total[kind]
            gb[kind] += g
            gl[size] += g
            for k, v in enumerate(vote):
                gw[kind][k][v] += g
        lw = [x - (2 / len(kinds)) * (g + 1e-4 * x) for x, g in zip(lw, gl)]
        for kind in kinds:
            bias[kind] -= 2 * gb[kind]
            w[kind] = [[x - 2 * (g + 1e-4 * x) for x, g in zip(a, b)] for a, b in zip(w[kind], gw[kind])]
    return bias, w, lw


def classifier(spans: DataFrame) -> Model | None:
    """One pass: each text gives the votes of its candidates of all kinds."""
    cell = lambda kind: lambda c: F.struct(F.lit(kind).alias("kind"), F.array(*votes(c, kind)).alias("votes"), length_class(c).alias("size"))
    each = spans.select(F.explode_outer(F.concat(*[F.transform(f"__p_{k}", cell(k)) for k in CANDIDATES])).alias("c")).where("c IS NOT NULL")
    cells = each.groupBy("c").agg(F.count("*").alias("n")).collect()  # at most 3^6 * 4 rows a kind
    return fit(sorted((r["c"]["kind"], tuple(r["c"]["votes"]), r["c"]["size"], r["n"]) for r in cells)) if cells else None


def judge(kind: str, model: Model):
    """Whether a candidate becomes a span."""
    bias, w, lw = model
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at)

    def judged(c: Column) -> Column:
        z = F.lit(bias[kind]) + pick(lw, length_class(c))
        for values, vote in zip(w[kind], votes(c, kind)):
            z = z + pick(values, vote)
        return z >= 0

    return judged


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with __p_<kind> (arrays of spans) for base and judged kinds, and __p_text."""
    df = with_spans(docs, text)
    model = classifier(with_spans(docs.select(text), text))
    for kind in CANDIDATES:
        keep = judge(kind, model) if model and kind in model[0] else lambda c: F.lit(False)
        df = df.withColumn(f"__p_{kind}", F.filter(f"__p_{kind}", keep))
    return df


def listed(kinds: list[str]) -> Column:
    def written(kind: str) -> Column:
        return F.transform(f"__p_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["s"], s["e"]))

    return F.array_join(F.concat(*map(written, kinds)), ",")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_<kind> of base and judged kinds and n_spans, their sum (long), base_sha256 and spans (kind:start:end)."""
    docs, names = covered(docs, ADDED)
    df = find(docs, names[text])
    counts = [F.size(f"__p_{k}").cast("long").alias(f"n_{k}") for k in [*KINDS, *CANDIDATES]]
    every = sum((F.size(f"__p_{k}") for k in CANDIDATES), sum((F.size(f"__p_{k}") for k in KINDS), F.lit(0))).cast("long").alias("n_spans")
    keep = [F.col(n).alias(c) for c, n in names.items()]
    return df.select(*keep, *counts, every, F.sha2(listed([*KINDS]), 256).alias("base_sha256"), listed([*KINDS, *CANDIDATES]).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span, or run of spans that overlap, replaced by its first kind in brackets."""
    docs, names = covered(docs)
    text = names[text]
    df = find(docs, text)

    def named(kind: str) -> Column:
        return F.transform(f"__p_{kind}", lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), F.lit(kind).alias("k")))

    df = df.withColumn("__p_all", F.array_sort(F.concat(*map(named, [*KINDS, *CANDIDATES]))))
    # runs of overlapping spans: one begins where a span starts at or after the greatest end before it
    df = df.withColumn("__p_reach", running(F.col("__p_all"), lambda at, p: F.greatest(at, p["e"])))
    df = df.withColumn("__p_first", F.filter(F.transform("__p_all", lambda p, i: F.struct(p["s"].alias("s"), i.alias("i"), p["k"].alias("k"))), lambda p: (p["i"] == 0) | (p["s"] >= F.get(F.col("__p_reach"), p["i"] - 1))))
    last = lambda j: F.coalesce(F.get(F.col("__p_first"), j + 1)["i"], F.size("__p_all")) - 1
    df = df.withColumn("__p_all", F.transform("__p_first", lambda p, j: F.struct(p["s"].alias("s"), F.get(F.col("__p_reach"), last(j)).alias("e"), p["k"].alias("k"))))
    ahead = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__p_all"), i - 1)["e"])
    parts = F.transform("__p_all", lambda p, i: F.concat(F.substring(F.col("__p_text"), ahead(i) + 1, p["s"] - ahead(i)), F.lit("["), p["k"], F.lit("]")))
    rest = F.substring(F.col("__p_text"), F.element_at(F.col("__p_all"), -1)["e"] + 1, F.length("__p_text"))
    out = F.when(F.size("__p_all") == 0, F.col(text)).otherwise(F.concat(F.array_join(parts, ""), rest))
    return df.withColumn(text, out).select(*[F.col(n).alias(c) for c, n in names.items()])
