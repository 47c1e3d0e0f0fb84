"""Personal data by patterns, checksums and context, in DataFrame functions only.

Each kind has a pattern that proposes spans, a validator (Luhn for cards, mod-97 for IBANs, ranges for addresses) and a
score; context words within ``NEAR`` characters raise it.  A span counts from ``THRESHOLD`` on.  The four base kinds
score above it by themselves, and so do ``secret`` (credentials that are assigned or tell by their form); ``iban`` needs its
checksum, ``ssn`` and ``local_phone`` need context.

The patterns are those of the contract with possessive quantifiers and look-behinds that leave the matches as they are,
so that every scan takes linear time and no deep stack, also on very long runs.  Positions come from the pieces
between the matches; their running sums are taken in blocks, so that texts with very many matches stay cheap.

Defined cases: a null text counts as empty and has no spans; rows are independent, so ties and repeated rows need no care;
``redact`` keeps all columns, and a null text stays null; ``find`` replaces a column named like its result (``out``), and
working columns take names that the table doesn't have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import fresh

NEAR = 40
THRESHOLD = 0.5
BLOCK = 64

# Patterns and context words.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Assigned credentials, and keys that their own form tells.
SECRET = '(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key) ?[:=] ?["\']?[A-Za-z0-9_/+=.-]{20,}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----'


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    trigger: str  # a cheaper pattern that every match contains
    score: float
    context: str = ""
    bonus: float = 0.4


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|host|server|address|client"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![0-9])(?![ -][0-9])", "[0-9][0-9 -]{11,}[0-9]", 0.7, "card|visa|master|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax"),
    Kind("iban", LEFT + "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + RIGHT, "[A-Z]{2}[0-9]{2}[A-Z0-9 ]{8}", 0.6, "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", LEFT + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + RIGHT, "[0-9]-[0-9]{2}-[0-9]", 0.2, "ssn|social security"),
    Kind("secret", SECRET, SECRET, 0.8),
    Kind("local_phone", LEFT + "[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}" + RIGHT, "[0-9][ .-][0-9]{3}[ .-][0-9]", 0.2, "phone|tel|call|mobile|fax"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    turned = F.reverse(_digits(x))

    def add(total, i):
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add) % 10 == 0


def _mod97(x: Column) -> Column:
    bare = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.substring(bare, 1, 4))

    def add(rest, c):
        v = F.ascii(c)
        return F.when(v < 65, rest * 10 + v - 48).otherwise(rest * 100 + v - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.char_length(_digits(x)).between(9, 15)
    if kind == "iban":
        return _mod97(x)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """The sum of the lengths before each place, in blocks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def inside(b):
        own = F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))
        return F.transform(own, lambda _, j: total(F.slice(sums, F.lit(1), b)) + total(F.slice(own, F.lit(1), j)))

    return F.flatten(F.transform(blocks, inside))


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text: str = "text", out_name: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: kind, start and end (code points, end exclusive), score and value, by kind, then start."""
    own = fresh(docs, "_pii")
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    pre = {k.name: (F.contains(t, F.lit("@")) if k.trigger == "@" else t.rlike(k.trigger)) for k in kinds}
    out = docs.withColumns({f"{own}_m_{k.name}": F.when(pre[k.name], F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in kinds})
    out = out.withColumns({f"{own}_p_{k.name}": F.when(F.size(f"{own}_m_{k.name}") > 0, F.split(t, k.pattern, -1)).otherwise(none) for k in kinds})
    # every match with the piece before it and the piece after it
    near = lambda k, a, b: (F.concat(F.right(a, F.lit(NEAR)), F.lit("\n"), F.left(b, F.lit(NEAR))).rlike(rf"(?i)(?:^|[^a-z])(?:{k.context})") if k.context else F.lit(False))
    run = lambda k: F.transform(F.col(f"{own}_m_{k.name}"), lambda m, i: F.char_length(m) + F.char_length(F.get(F.col(f"{own}_p_{k.name}"), i)))
    out = out.withColumns({f"{own}_l_{k.name}": F.when(F.size(f"{own}_m_{k.name}") > 0, _running(run(k))) for k in kinds})

    def spans(k):
        pieces, before = F.col(f"{own}_p_{k.name}"), F.col(f"{own}_l_{k.name}")

        def one(m, i):
            start = F.get(before, i) + F.char_length(F.get(pieces, i))
            score = F.lit(k.score) + F.when(near(k, F.get(pieces, i), F.get(pieces, i + 1)), k.bonus).otherwise(0.0)
            return F.struct(F.lit(k.name).alias("kind"), start.cast("long").alias("start"), (start + F.char_length(m)).cast("long").alias("end"), F.least(F.round(score, 2), F.lit(1.0)).alias("score"), m.alias("value"))

        found = F.filter(F.transform(F.col(f"{own}_m_{k.name}"), one), lambda s: _valid(k.name, s["value"]) & (s["score"] >= THRESHOLD))
        empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>")
        return F.when(F.size(f"{own}_m_{k.name}") > 0, found).otherwise(empty)

    out = out.withColumns({f"{own}_s_{k.name}": spans(k) for k in kinds})
    return out.withColumn(out_name, F.concat(*(F.col(f"{own}_s_{k.name}") for k in kinds))).drop(*(f"{own}_{x}_{k.name}" for k in kinds for x in "mpls"))


def digest(found: DataFrame) -> DataFrame:
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of(*BASE)
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with each span (or union of overlapping spans) replaced by its kind in angle brackets, and ``n_chars`` to match."""
    spans = fresh(docs, "_found")
    found = find(docs, kinds, out_name=spans).withColumn(spans, F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], mark).alias("out")))

    done = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.char_length("text"))))
    out = found.withColumn("text", F.when(F.col("text").isNotNull() & (F.size(spans) > 0), done).otherwise(F.col("text"))).drop(spans)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
