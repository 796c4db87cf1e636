"""Personal data by weak supervision, with DataFrame functions only.

Strict patterns give base spans; wider ones give candidates: addresses spelt out, version 6 addresses, cards inside runs
of digits that are too long to be one, national phone numbers, and long tokens that may be secrets. Four labelers vote
on every span or abstain: its shape (check digits, hexadecimal digits), a gazetteer (top-level domains, network, issuer
and country prefixes, prefixes of issued keys), the words before it, and its borders. Expectation-maximisation over the
counts of vote patterns, which cover the whole corpus and are few, estimates how reliable each labeler is. Its
posteriors train a logistic span classifier on what the span and its neighbours look like (length, shares of digits and
letters, check digits, signs and words around), not on the votes. It is compiled into a column expression. Candidates
that it accepts are added; base spans always stay.

Everything on rows is built-in functions inside the JVM: matches and the pieces between them give places by running sums
of lengths, in blocks, so that time grows with the text and its matches. No row leaves the JVM and nothing is shuffled
but counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, written

KINDS = ["email", "ip", "card", "phone", "secret"]
#: What a strict match is. Possessive quantifiers where no shorter match could follow, and starts that can't be inside a
#: run that already failed, keep the time linear; the matches are those of the plain patterns.
STRICT = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: Candidates beyond the strict patterns.
WIDE = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,8}",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9A-Za-z])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{13})(?![0-9A-Za-z])",
    r"(?<![0-9+().-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![A-Za-z0-9_-])(?=[0-9_-]{0,64}+[A-Za-z])[A-Za-z0-9_-]{16,}+",
]
LONGEST = 256
#: What a text needs for a pattern to be tried: strict, wide.
NEEDS = [("@", ""), (".", ":"), ("", ""), ("+", ""), ("", "")]
#: The gazetteer and the context words.
GAZETTEER = [
    r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|int|info|io|dev|app|de|fr|es|uk|it|nl|eu|ch|at|be|pl|se|us|ca|au|jp|cn|in|br|mx)$",
    r"^(?:[1-9][0-9]{0,2}\.|2[0-9A-Fa-f]{3}:|fe80:|fd[0-9a-f]{2}:)",
    r"^(?:4|5[ -]?[1-5]|2[ -]?[2-7]|3[ -]?[47]|6[ -]?(?:0[ -]?1[ -]?1|4|5)|3[ -]?5)",
    r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
    r"^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_|pk_|rk_|eyJ)",
]
FOR = [
    r"(?i)e-?mail|contact|write|correo|courriel",
    r"(?i)\bip\b|host|server|address|addr",
    r"(?i)card|visa|credit|payment|tarjeta|karte|carte",
    r"(?i)phone|tel\b|call|fax|mobile|telefon",
    r"(?i)(?:token|passw(?:or)?d|pwd|secret|api.?key|access.?key|credential|bearer)[\"']?\s*[=: ]\s*[\"']?$",
]
AGAINST = r"(?i)version|isbn|issn|order|invoice|serial|build|release"
ACCEPT, BEFORE = 0.5, 24
VOTES = ["by_shape", "by_gazetteer", "by_context", "by_border"]
#: How often a labeler's votes are thought to be right before any are counted, and the weight of that.
RIGHT, PRIOR = (0.95, 0.7, 0.8, 0.6), 0.05
#: Array elements and characters that are handled at once, so that time grows in proportion to an array or a text.
BLOCK, PIECE = 256, 1024


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, where x is made once however often f uses it, also inside functions of elements."""
    return F.transform(F.array(x), f)[0]


def running(x: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs, step over all elements before it; block by block, as appending costs a copy."""
    start = lambda o: F.struct(o.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    scan = lambda v, o: F.aggregate(v, start(o), lambda a, y: F.struct(step(a["at"], y).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
    total = lambda b: F.aggregate(b, F.lit(zero).cast("long"), step)
    return let(x, lambda v: F.when(F.size(v) > 0, let(blocks(v), lambda bs: F.flatten(F.zip_with(bs, scan(F.transform(bs, total), F.lit(zero)), scan)))).otherwise(v))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; none doesn't."""
    n = F.length(digits)
    at = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    double = lambda i: F.when(i % 2 == 1, at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)).otherwise(at(i))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + double(i)) % 10 == 0).otherwise(False)


def valid(kind: Column, base: Column, m: Column) -> Column:
    """What a match must hold besides its pattern."""
    small = lambda p: let(F.ltrim(p, F.lit("0")), lambda q: F.when(F.length(q) <= 3, F.concat(F.lit("0"), q).cast("int")).otherwise(999) <= 255)
    strict = lambda d: (
        F.when(kind == 1, F.forall(F.split(m, "\\."), small)).when(kind == 2, F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)).when(kind == 3, F.length(d).between(8, 15)).otherwise(True)
    )
    return F.when(base, let(F.regexp_replace(m, "[^0-9]", ""), strict)).otherwise(F.length(m) <= LONGEST)


def _spans(kind: Column, base: Column, m: Column, p: Column) -> Column:
    """The valid matches as structs (start, end, kind, base, match, before, after), from matches and the pieces between them."""
    ends = running(F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long")), 0, lambda a, b: a + b)
    parts = F.arrays_zip(ends.alias("at"), m.alias("m"), F.slice(p, 1, F.size(m)).alias("b"), F.slice(p, 2, F.size(m)).alias("a"))
    return F.transform(
        F.filter(parts, lambda s: valid(kind, base, s["m"])),
        lambda s: F.struct(
            (s["at"] + F.length(s["b"])).alias("start"), (s["at"] + F.length(s["b"]) + F.length(s["m"])).cast("long").alias("end"), kind.alias("kind"), base.alias("base"), s["m"].alias("match"),
            F.when(F.length(s["b"]) > BEFORE, F.right(s["b"], F.lit(BEFORE))).otherwise(s["b"]).alias("before"), F.substring(s["a"], 1, 1).alias("after"),
        ),
    )


FAR = 1 << 60


def _apart(spans: Column) -> Column:
    """Base spans and those others that don't overlap one, in order."""

    def free(s: Column) -> Column:
        done = running(F.transform(s, lambda x: F.when(x["base"], x["end"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
        next_ = F.reverse(running(F.reverse(F.transform(s, lambda x: F.when(x["base"], x["start"]).otherwise(FAR))), FAR, lambda a, b: F.least(a, b)))
        kept = F.filter(F.arrays_zip(s.alias("s"), done.alias("done"), next_.alias("next")), lambda z: z["s"]["base"] | ((z["done"] <= z["s"]["start"]) & (z["next"] >= z["s"]["end"])))
        return F.transform(kept, lambda z: z["s"])

    return let(F.array_sort(spans), free)


def candidates(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with an array of base spans and candidates of every kind; candidates that overlap a base span are left out.

    Places are code points, end exclusive. A null text has none.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))

    def found(k: int, wide: bool) -> Column:
        pattern, need = (WIDE if wide else STRICT)[k], NEEDS[k][wide]
        tried = t.contains("(at)") | t.contains("[at]") if wide and k == 0 else F.contains(t, F.lit(need)) if need else F.lit(True)
        some = lambda m: F.struct(F.lit(k).alias("kind"), F.lit(not wide).alias("base"), m.alias("m"), F.when(F.size(m) > 0, F.split(t, pattern, -1)).alias("p"))
        return let(F.when(tried, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), some)

    every = F.filter(F.array(*[found(k, w) for k in range(len(KINDS)) for w in (False, True) if w or k < len(STRICT)]), lambda z: z["p"].isNotNull())
    spans = F.flatten(F.transform(every, lambda z: _spans(z["kind"], z["base"], z["m"], z["p"])))
    return docs.withColumn(out, let(spans, lambda s: F.when(F.size(s) > 0, _apart(s)).otherwise(s)))


def votes(s: Column) -> dict[str, Column]:
    """The labelers' votes on a span: 1 for, -1 against, 0 abstains."""
    kind = s["kind"]
    by_kind = lambda text, patterns: F.coalesce(*[F.when(kind == k, F.rlike(text, F.lit(p))) for k, p in enumerate(patterns)])
    digits = F.regexp_replace(s["match"], "[^0-9]", "")
    hexed = F.rlike(s["match"], F.lit("^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{20})$"))
    edge = F.rlike(s["before"], F.lit(r"[\p{L}\p{N}/@.]$")) | F.rlike(s["after"], F.lit(r"^[\p{L}\p{N}/@]"))
    return {
        "by_shape": F.when(kind == 2, F.when(luhn(digits), 1).otherwise(-1)).when(kind == 4, F.when(F.length(digits) < 2, -1).when(hexed, 1).otherwise(0)).when(s["base"], 1).otherwise(0),
        "by_gazetteer": F.when(by_kind(s["match"], GAZETTEER), 1).when(kind == 4, 0).otherwise(-1),
        "by_context": F.when(by_kind(s["before"], FOR), 1).when(F.rlike(s["before"], F.lit(AGAINST)), -1).otherwise(0),
        "by_border": F.when(edge, -1).otherwise(1),
    }


def reliabilities(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of candidates of each (kind, votes) pattern by expectation-maximisation over (kind, votes, spans, base spans).

    The labelers vote independently given the truth, with rates of their own for each vote and truth, which all kinds
    share but for the share of true spans. Base spans are known to be true. Rates start at RIGHT, and a share PRIOR of
    all spans is added to what is counted with these rates, so that truth and falsehood can't change places where there
    are few base spans.
    """
    width, total = len(VOTES), sum(n for _, _, n, _ in counts)
    first = {(j, y, v): (RIGHT[j] if (v > 0) == y else 1 - RIGHT[j]) if v else 0.5 for j in range(width) for y in (True, False) for v in (-1, 0, 1)}
    rate = dict(first)
    share = {k: 0.5 for k, *_ in counts}
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for k, vs, *_ in counts:
            yes = math.log(share[k]) + sum(math.log(rate[j, True, v]) for j, v in enumerate(vs))
            no = math.log(1 - share[k]) + sum(math.log(rate[j, False, v]) for j, v in enumerate(vs))
            post[k, vs] = 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))
        true = [base + (n - base) * post[k, vs] for k, vs, n, base in counts]
        for k in share:
            share[k] = (sum(t for t, c in zip(true, counts, strict=True) if c[0] == k) + 1) / (sum(c[2] for c in counts if c[0] == k) + 2)
        for j in range(width):
            for y in (True, False):
                weight = {v: (1 + PRIOR * total) * first[j, y, v] for v in (-1, 0, 1)}
                for t, (_, vs, n, _) in zip(true, counts, strict=True):
                    weight[vs[j]] += t if y else n - t
                every = sum(weight.values())
                for v in weight:
                    rate[j, y, v] = weight[v] / every
    return post


def looks(s: Column) -> list[Column]:
    """What the span classifier sees of a span, each 0 or 1: nothing of the votes."""
    m, n = s["match"], F.length(s["match"])
    share = lambda c: F.length(F.regexp_replace(m, f"[^{c}]", "")) / n
    last = lambda p: F.rlike(s["before"], F.lit(p))
    tests = [
        n < 16, n == 16, n == 20, (n > 16) & (n < 32) & (n != 20), n == 32, n == 40, n > 40,
        share("0-9") == 0, share("0-9") < 0.2, share("0-9") >= 0.5, share("0-9") == 1, share("A-Z") >= 0.5, share("a-z") == 1, share("0-9A-Fa-f") == 1,
        luhn(F.regexp_replace(m, "[^0-9]", "")),
        last(r"[=:]\s*$"), last(r"[\"']$"), last(r"[0-9][ -]?$"), last(r"\p{L}$"), last(r"\p{L}\s$"), last(r"(?i)(?:token|passw|pwd|secret|key)"),
        F.rlike(s["after"], F.lit(r"^[\"']")), F.rlike(s["after"], F.lit(r"^\p{L}")), F.rlike(s["after"], F.lit(r"^(?:\s|$)")),
    ]
    return [t.cast("int") for t in tests]


def features(kind: Column, look: list[Column]) -> list[Column]:
    """A constant and the looks, apart for each kind."""
    return [F.when(kind == k, x).otherwise(0).cast("double") for k in range(len(KINDS)) for x in [F.lit(1), *look]]


def vote_counts(spans: DataFrame, col: str = "spans") -> DataFrame:
    """(kind, votes, look as one number, n, known: how many are base spans) for all spans of a frame: no more rows than there are kinds of spans."""
    s = spans.filter(F.size(col) > 0).select(F.explode(col).alias("s"))
    look = looks(F.col("s"))
    packed = sum((x.cast("long") * (1 << i) for i, x in enumerate(look[1:], 1)), look[0].cast("long"))
    return s.select(F.col("s.kind").alias("kind"), *[c.alias(n) for n, c in votes(F.col("s")).items()], packed.alias("look"), "s.base").groupBy("kind", *VOTES, "look").agg(F.count("*").alias("n"), F.count_if("base").alias("known"))


def train(spans: DataFrame, col: str = "spans") -> list[float] | None:
    """Weights of the span classifier, from all spans of a frame; None if there are none.

    What reaches the driver is a count for each kind and vote pattern, 5 * 3 ** 4 rows at most. The classifier is fitted
    on the counts of looks, each once as true and once as false, weighted by count and posterior.
    """
    cells = written(vote_counts(spans, col), "votes")
    rows = cells.groupBy("kind", *VOTES).agg(F.sum("n").alias("n"), F.sum("known").alias("known")).collect()
    counts = [(r["kind"], tuple(r[v] for v in VOTES), r["n"], r["known"]) for r in rows]
    if not counts:
        return None
    post = reliabilities(sorted(counts))
    table = spans.sparkSession.createDataFrame([(k, *vs, float(q)) for (k, vs), q in sorted(post.items())], f"kind int, {', '.join(f'{v} int' for v in VOTES)}, post double")
    known = cells.join(F.broadcast(table), ["kind", *VOTES]).withColumn("yes", F.col("known") + (F.col("n") - F.col("known")) * F.col("post"))
    known = known.groupBy("kind", "look").agg(F.sum("yes").alias("yes"), F.sum(F.col("n") - F.col("yes")).alias("no"))
    x = features(F.col("kind"), [F.getbit("look", F.lit(i)).cast("int") for i in range(len(looks(F.col("s"))))])
    both = known.select(F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")), F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight")))).alias("e"), array_to_vector(F.array(*x)).alias("features"))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=100, standardization=False, fitIntercept=False).fit(both.select("e.label", "e.weight", "features").filter("weight > 0").coalesce(8))
    discard(cells)
    return [float(w) for w in model.coefficients]


def score(s: Column, weights: list[float]) -> Column:
    """The classifier's probability of a span as a column expression."""
    look, size = looks(s), len(looks(s)) + 1
    own = F.element_at(F.array(*[F.array(*map(F.lit, weights[k * size : (k + 1) * size])) for k in range(len(KINDS))]), s["kind"] + 1)
    total = F.aggregate(F.zip_with(F.array(F.lit(1), *look), own, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-total))


def _ordered(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s.alias("s")))), lambda x: x["s"])


def accepted(spans: Column, weights: list[float] | None) -> Column:
    """Base spans, and candidates that the classifier scores at ACCEPT or more, in order of kind and start."""
    return spans if weights is None else _ordered(F.filter(spans, lambda s: s["base"] | (score(s, weights) >= ACCEPT)))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of each document.

    n_email to n_phone count base spans, base_sha256 is the digest of their list kind:start:end, spans lists all. A null
    or empty text has none. Repeated rows get repeated rows. Texts are read once; their spans are a written table.
    """
    found = written(candidates(docs.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "spans"), "spans")
    model = train(found)
    base = _ordered(F.filter("spans", lambda s: s["base"]))
    done = found.withColumn("__base", base).withColumn("__all", accepted(F.col("spans"), model))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return done.select(id_col, *[count(k).alias(f"n_{KINDS[k]}") for k in range(len(STRICT))], F.sha2(_named(F.col("__base")), 256).alias("base_sha256"), _named(F.col("__all")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; where spans overlap, the first one's name stands for all.

    A column n_chars, if there, follows the new text. Other columns and texts without spans stay as they are. Texts are
    read once and written with their spans, so no pattern runs twice.
    """
    columns = docs.columns
    found = written(candidates(docs, text_col, "__pii"), "pii")
    model = train(found, "__pii")
    spans = F.array_sort(F.transform(accepted(F.col("__pii"), model), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def part(blocks: Column, at: Column, n: Column) -> Column:
        first = F.floor(at / PIECE)
        some = F.slice(blocks, (first + 1).cast("int"), (F.floor((at + n - 1) / PIECE) - first + 1).cast("int"))
        return F.when(n > 0, F.substr(F.array_join(some, ""), (at - first * PIECE + 1).cast("int"), n.cast("int"))).otherwise("")

    def new(t: Column, blocks: Column, s: Column) -> Column:
        done = running(F.transform(s, lambda x: x["end"]), 0, lambda a, b: F.greatest(a, b))
        own = F.transform(F.filter(F.arrays_zip(s.alias("s"), done.alias("done")), lambda z: z["s"]["start"] >= z["done"]), lambda z: F.concat(part(blocks, z["done"], z["s"]["start"] - z["done"]), F.element_at(names, z["s"]["kind"] + 1)))
        end = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(own, ""), part(blocks, end, F.length(t) - end))

    t = F.col(text_col)
    cut = let(spans, lambda s: F.when(F.size(s) > 0, let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda b: new(t, b, s))))
    found = found.withColumn(text_col, F.coalesce(F.when(F.size("__pii") > 0, cut), t))
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents."""
    return detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
