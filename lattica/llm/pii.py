"""Personal data: overlapping candidates of high recall, boosted trees on format and context, calibrated thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, spans
from .boosting import boost

BASE = ["email", "ip", "card", "phone"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beside those: anything about an at sign, four groups of digits, and any longer run of digits and their separators.
LOOSE_MAIL = r"(?<![^\s<>()\[\],;:])[^\s<>()\[\],;:@]++@[^\s<>()\[\],;:@]++"
LOOSE_IP = r"(?<![0-9])[0-9]{1,3}+(?:[.\x20-][0-9]{1,3}+){3}"
LOOSE_NUMBER = r"(?<![0-9+])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
EXTRA = ["mail_like", "ip_like", "number_like"]
#: Words that announce each family within so many code points before a candidate, with two short words between at most;
#: the last ones announce numbers of other things.
CONTEXT = 28
CUES = {
    "mail": "e-?mail|mail|mailto|contact|write",
    "ip": "ip|ipv4|host|server|address|addr|ping",
    "phone": "tel|telephone|phone|call|mobile|cell|fax|text|whatsapp|dial",
    "card": "card|visa|mastercard|amex|iban|account|acct|pan",
    "other": "order|invoice|item|isbn|issn|serial|version|part|ticket|case|page|ref|reference|sku|code|tracking|number|id",
}
OWN = {"mail_like": ("mail",), "ip_like": ("ip",), "number_like": ("phone", "card")}
#: Probability from which a candidate is taken.
SELECT = 0.5
#: What the trees may ask of a candidate's form, and of what stands before it, with the features' ranges.
FORM = {"family": 3, "digits": 21, "groups": 7, "plus": 2, "parens": 2, "luhn": 2, "small": 2, "dots": 5, "signs": 5, "domain": 2}
BEFORE = {"family": 3, "cue": 6, "edge": 4}


def _kinds() -> list[spans.Kind]:
    text = F.col("text")
    at = F.contains(text, F.lit("@"))
    return [
        ("email", EMAIL, at),
        ("ip", IP, None),
        ("card", CARD, None),
        ("phone", PHONE, F.contains(text, F.lit("+"))),
        ("mail_like", LOOSE_MAIL, at),
        ("ip_like", LOOSE_IP, None),
        ("number_like", LOOSE_NUMBER, None),
    ]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + F.lit(1), F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when(n == 0, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def _holds() -> Column:
    """The base rules' conditions on their matches."""
    digits = F.length(_digits(F.col("match")))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("match").rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(F.col("kind") == 2, F.when(digits.between(16, 19), _luhn(_digits(F.col("match")))).otherwise(False))
        .when(F.col("kind") == 3, digits.between(8, 15))
        .otherwise(False)
    )


def _features(found: DataFrame) -> DataFrame:
    m, before = F.col("match"), F.col("before")
    digits = _digits(m)
    cue = F.lit(0)
    for k, words in reversed(list(enumerate(CUES.values(), 1))):
        cue = F.when(before.rlike(rf"(?i)(?<![\p{{L}}0-9])(?:{words})s?[^\p{{L}}0-9]{{1,4}}(?:\p{{L}}{{1,6}}[^\p{{L}}0-9]{{1,3}}){{0,2}}$"), k).otherwise(cue)
    edge = F.right(before, F.lit(1))
    cols = {
        "family": F.col("kind") - len(BASE),
        "digits": F.least(F.length(digits), F.lit(20)),
        "groups": F.least(F.size(F.split(m, r"[^0-9]+")), F.lit(6)),
        "plus": F.startswith(m, F.lit("+")).cast("int"),
        "parens": F.contains(m, F.lit("(")).cast("int"),
        "luhn": F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False).cast("int"),
        "small": F.when(m.rlike(r"(?<![0-9])(?:25[6-9]|2[6-9][0-9]|[3-9][0-9]{2}|[0-9]{4,})(?![0-9])"), 0).otherwise(1),
        "dots": F.least(F.length(F.regexp_replace(m, r"[^.]", "")), F.lit(4)),
        "signs": F.least(F.length(F.regexp_replace(m, r"[^\x20-]", "")), F.lit(4)),
        "domain": m.rlike(r"@[^@]*[^@.]\.[^@.]{2,}$").cast("int"),
        "cue": cue,
        "edge": F.when(F.length(edge) == 0, 0).when(edge.rlike(r"\s"), 1).when(edge.rlike(r"[\p{L}0-9]"), 2).otherwise(3),
    }
    return found.withColumns({k: v.cast("int") for k, v in cols.items()})


def _calibration(raw: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and shift that make ``raw`` log-odds of ``good`` on counted candidates, drawn to 1 and 0 where these are few."""
    w, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    x, total = np.stack((raw, np.ones(len(raw))), 1), good + bad
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (total * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (good - total * p) - ridge * (w - start))
        w += np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return float(max(0.0, w[0])), float(w[1])


def _merged(x: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts of equal rows of ``x`` added up."""
    rows, at = np.unique(x, axis=0, return_inverse=True)
    return rows, *(np.bincount(at.reshape(-1), c, len(rows)) for c in counts)


def learn(counted: list) -> str:
    """The log-odds of a candidate, as SQL over its features, from counts of all candidates by feature combination.

    No labels come with the corpus, so two views that don't share their evidence label each other. One set of trees sees
    the form alone, and is told which candidates a base span covers or a word of their family announces; the other sees
    what stands before alone, and is told which candidates a base span covers. Documents of even hash train the trees,
    odd ones calibrate them by family. Log-odds of both views add up, less those of the family.
    """
    names = [*FORM, *(k for k in BEFORE if k != "family")]
    x = np.array([[r[k] for k in names] for r in counted], np.int64).reshape(-1, len(names))
    base, rest, odd = (np.array([r[k] for r in counted], np.int64) for k in ("base", "rest", "odd"))
    own = np.zeros(len(x), bool)
    cues = list(CUES)
    for family, name in enumerate(EXTRA):
        own |= (x[:, 0] == family) & np.isin(x[:, names.index("cue")], [1 + cues.index(c) for c in OWN[name]])
    views = {"form": (list(FORM), np.where(own, base + rest, base), np.where(own, 0, rest)), "before": (list(BEFORE), base, rest)}
    total = []
    for columns, good, bad in views.values():
        cols = [names.index(c) for c in columns]
        some, g, b = _merged(x[odd == 0][:, cols], good[odd == 0], bad[odd == 0])
        model = boost(columns, some, g, b)
        held, g, b = _merged(x[odd == 1][:, cols], good[odd == 1], bad[odd == 1])
        raw = model.raw(held)
        fits = [_calibration(raw[held[:, 0] == f], g[held[:, 0] == f], b[held[:, 0] == f]) for f in range(len(EXTRA))]
        slope, shift = (f"element_at(array({', '.join(f'{fit[k]!r}D' for fit in fits)}), family + 1)" for k in (0, 1))
        total.append(f"{slope} * ({model.sql()}) + {shift}")
    shares = [(base[x[:, 0] == f].sum() + 1, rest[x[:, 0] == f].sum() + 1) for f in range(len(EXTRA))]
    usual = ", ".join(f"{float(np.log(g / b))!r}D" for g, b in shares)
    return f"{' + '.join(total)} - element_at(array({usual}), family + 1)"


def _overlap(found: DataFrame, which: Column, name: str) -> DataFrame:
    """``found`` with a column ``name``: whether another span, one of ``which``, overlaps a span. Spans of ``which`` that
    start together with it must come first by ``kind`` or be base spans."""
    along = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("base"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("doc_id", "text_hash").orderBy(F.desc("start"), F.desc("base"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.when(which, F.col("end"))).over(along) > F.col("start"), F.lit(False))
    after = F.coalesce(F.min(F.when(which, F.col("start"))).over(back) < F.col("end"), F.lit(False))
    return found.withColumn(name, before | after)


def find_personal(docs: DataFrame, select: float = SELECT) -> DataFrame:
    """Base spans, and candidates that the trees accept: doc_id, text_hash, kind, name, start, end.

    Every candidate of the corpus is counted (a table bounded by the features' ranges) to train and calibrate the trees.
    Those of probability ``select`` or more that no base span touches are added, of overlapping ones the first family.
    Null and empty texts have none; equal rows (same doc_id and text) give theirs once; an empty table gives none.
    """
    found = common.written(spans.spans(docs, _kinds(), CONTEXT).withColumn("base", _holds()).where((F.col("kind") >= len(BASE)) | F.col("base")))
    rated = common.written(_features(_overlap(found, F.col("base"), "touched")).drop("before", "match"))
    names = [*FORM, *(k for k in BEFORE if k != "family")]
    candidates = rated.where(F.col("kind") >= len(BASE))
    counted = candidates.groupBy(*names, F.pmod("text_hash", F.lit(2)).alias("odd")).agg(F.sum(F.col("touched").cast("long")).alias("base"), F.sum((~F.col("touched")).cast("long")).alias("rest")).collect()
    taken = F.expr(learn(counted)) >= float(np.log(select / (1 - select)))
    kept = rated.where(F.when(F.col("base"), True).otherwise(~F.col("touched") & taken))
    for family in range(len(EXTRA) - 1):
        kept = _overlap(kept, F.col("kind") == len(BASE) + family, "hidden").where(F.col("base") | (F.col("family") <= family) | ~F.col("hidden"))
    label = F.array(*(F.lit(k) for k in BASE + EXTRA))
    return kept.select("doc_id", "text_hash", "kind", F.get(label, F.col("kind")).alias("name"), "start", "end")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets (overlapping spans by the first's); all else kept.

    Null texts stay null, repeated rows are redacted each, and n_chars follows where there is such a column. Only rows
    with spans are shuffled, to meet them.
    """
    found = find_personal(common.spread(common.keyed(docs)))
    order = ("start", F.desc("end"), "kind")
    along = Window.partitionBy("doc_id", "text_hash").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("reach", F.coalesce(F.max("end").over(along), F.lit(0)))
    run = Window.partitionBy("doc_id", "text_hash").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("run", F.sum((F.col("start") >= F.col("reach")).cast("int")).over(run))
    merged = found.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("name", F.struct("start", "kind")).alias("name"))
    per = common.written(merged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias("cuts")))
    text, own = F.col("text"), F.col("doc_id").cast("long")
    doc, same, cuts = (common.fresh(docs, x) for x in ("cut_doc", "cut_text", "cuts"))
    text_hash = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    sure, rest = common.divided(docs, F.xxhash64(own, text_hash), per.select(F.xxhash64("doc_id", "text_hash").alias("k")))
    rest = rest.join(per.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(same), F.col("cuts").alias(cuts)), own.eqNullSafe(F.col(doc)) & (text_hash == F.col(same)), "left")
    begins = F.concat(F.array(F.lit(0)).cast("array<long>"), F.transform(cuts, lambda s: s["end"]))
    pieces = F.transform(cuts, lambda s, i: F.concat(F.substring(text, F.get(begins, i).cast("int") + F.lit(1), (s["start"] - F.get(begins, i)).cast("int")), F.lit("["), s["name"], F.lit("]")))
    tail = F.substring(text, F.element_at(begins, -1).cast("int") + F.lit(1), F.length(text))
    new = F.when(F.col(cuts).isNull() | text.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(cuts).isNull() | text.isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return sure.unionAll(rest.withColumns(changed).select(docs.columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, a row each; nulls, ties, repeats and empty tables as in ``spans.digests``."""
    docs = common.spread(common.keyed(common.table(spark, sf_dir, "documents")))
    return spans.digests(docs, find_personal(docs), BASE, by_start=False)
