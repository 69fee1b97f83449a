"""Problem 2: statistics of each text, and from them the texts that are mostly lists, tables or junk.

Method: the statistics that decide are those of running language: the share of function words (without those that stand in
lists), of lines that end like sentences, and the words a line. Each gets its exact rank among the reference texts of its language, those with as many
function words as prose has; texts whose language can't be told are ranked among the reference of all languages.
Different texts count once, however often they are copied. Ranks come from range partitions, whose running totals start
at those of the partitions before; what of the reference lies as far out is a value's tail probability, and the sum of
their negative logarithms a text's outlier score. The score decides whether a text is prose; what its lines look like
only names the kind of the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.common import cut_lineage, read_table

WORDS_A_PAGE = 300
#: Function words by language (fixed values).
COMMON = {
    "en": "the of and a to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would into has more her two like could no than been its who now my made over did down only may very after called just where i you he any under even however whereas while although because until unless during between through against such both either neither nor upon within without",
    "de": "der die das und in den von zu ist im für auf mit sich dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn weil jeden jeder eigener der",
    "fr": "le la les de des du et un une est en que qui dans pour par sur au avec ce il ne se pas plus son sa ses mais ou où on sont nous vous leur être cette aux comme tout lorsque reste chaque après avant",
    "es": "el la los las de del y un una es en que por para con se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde cada antes durante después mantiene",
}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
_ANY = frozenset().union(*_COMMON.values())
_TELLING = _ANY - frozenset("and or und et y e o oder ou".split())  # those that don't stand in list entries
_END = re.compile(r"[.!?…。！？।][\"'”’»)\]*_]*\s*(?:[\[(][^\])]{1,20}[\])]\.?)?\s*$")
_WORDLIKE = re.compile(r"(?<![^\s(\[\"'“‘«„¿¡*_/-])(?:[A-Za-zÄÖÜÉÈÀÁÍÓÚÑÇ][a-zäöüßéèêëàâáíóúñçîïôûùœæ’']{0,24}|[A-ZÄÖÜÉÈÀÁÍÓÚÑÇ]{2,25})(?![^\s.,;:!?)\]\"'”’»“…*_/-])")
_ALNUM, _DIGITS = re.compile(r"[^\W_]+"), re.compile(r"\d+")
_ASCII, _VOWEL = re.compile(r"[^a-zäöüéèêàâáíóúîôû]+"), re.compile(r"[aeiouyäöüéèêàâáíóúîôû]")
_BULLET = re.compile(r"\s*(?:[•◦▪·‣∙●○■□–—*+-]|\[[ xX]?\])\s+\S")
_NUMBER = re.compile(r"\s*(?:\(?(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|\d+(?:\.\d+)+\.?|§\s*\d+)\s+\S")
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\S{1,8}\s*$|…{2,}\s*\S{1,8}\s*$")
_INDEX = re.compile(r",\s*\d+(?:\s*[–-]\s*\d+)?(?:,\s*\d+(?:\s*[–-]\s*\d+)?)*\s*$")
_HTML = re.compile(r"<\s*/?\s*(?:tr|td|th|table|tbody|thead)\b", re.I)
_QUOTED = re.compile(r'\s*"[^"]*"(?:[,;\t]"[^"]*")+\s*$')
_SEMI = re.compile(r";(?=\S|$)")
_WIDE = re.compile(r"\S(?: {3,}|\s*\t)\s*\S")
_RULE = re.compile(r"[\s|:+=_-]{3,}$")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_PDF = re.compile(r"<<|>>|/[A-Z][A-Z0-9]*\b|\b(?:obj|endobj|stream|endstream|xref)\b|\b\d+ \d+ R\b")


def line_kind(line: str) -> str:
    """``list``, ``table``, ``junk``, ``prose``, ``phrase`` (a list entry unless it continues prose), or '' for headings
    and rules, which count for nothing."""
    s = line.strip()
    if s.startswith("#") and re.match(r"#{1,6}\s", s):
        return ""
    bullet = _BULLET.match(line) or _NUMBER.match(line)
    ended = _END.search(s)
    tail = s[-200:]  # what is tested at the line's end stands there
    words = s.lower().split()
    common = sum(map(_TELLING.__contains__, words))
    if _HTML.search(s) or _QUOTED.match(s):
        return "table"
    if s.count("|") >= 2 or (s.count("|") == 1 and not common):
        cells = [c for c in s.strip("|").split("|")]
        if _RULE.match(s):
            return "table"
        if max(len(c) for c in cells) <= 60 or s.startswith("|"):
            like = sum(map(len, _WORDLIKE.findall(s))) + sum(c.isdigit() or c in " |.," for c in s)
            if like >= 0.7 * len(s):
                return "table"
    if _RULE.match(s):
        return ""
    if not bullet and not common and not ended and (_WIDE.search(s) or s.count("\t") or len(_SEMI.findall(s)) >= 1) and _clean(s):
        return "table"
    like = sum(map(len, _WORDLIKE.findall(s)))
    solid = len(s) - s.count(" ") or 1
    if (common >= 1 and common >= 0.12 * len(words) and like >= 0.55 * solid) or (ended and like >= 0.7 * solid and len(words) >= 3 and not _LEADER.search(tail)):
        if not (bullet and common <= 1 and not ended):
            return "prose"
    if len(words) >= 8 and common < 0.06 * len(words) and not ended and len(set(words)) <= len(words) / 2:
        return "junk"  # the same few words again and again
    if common < 0.06 * len(words) and not ended and len(words) >= 4:
        letters = _ASCII.sub("", s.lower())
        if len(letters) >= 24 and len(_VOWEL.findall(letters)) < 0.29 * len(letters) and not any(map(str.isdigit, s)):
            return "junk"  # letters that don't make words
    if _LEADER.search(tail) or (_INDEX.search(tail) and like >= 0.3 * solid):
        return "list"
    if _PDF.search(s) and like < 0.75 * solid:
        return "junk"
    if bullet and (like >= 0.5 * solid):
        return "list"
    if like >= 0.75 * solid and len(s) <= 120:
        return ("list" if ":" in s else "phrase") if not common else "prose"
    if like < 0.5 * solid:
        return "junk" if solid > 12 else ""
    return "prose" if common else "phrase"


def _clean(s: str) -> bool:
    """Cells of words and numbers, not noise."""
    good = sum(map(len, _WORDLIKE.findall(re.sub(r"[;\t]", " ", s)))) + sum(c.isdigit() for c in s)
    return good >= 0.6 * (len(s) - s.count(" ") - s.count("\t") - s.count(";") or 1)


#: statistic -> the tail that speaks against prose: 1 for large values, -1 for small ones
STATISTICS = {"telling_word_share": -1, "ended_line_share": -1, "words_per_line": -1}
REFERENCE = 0.12  # least share of function words, but those that stand in lists, of the reference texts
OUTLIER = 8.5  # score from which a text is no prose,
ATTAINED = 0.8  # or this share of the largest score that a small reference allows
NAMED = 0.2  # least share of lines of some kind other than prose, so that there is a kind to name
HEAVY = 1000  # a value that more than one in so many rows has is joined by broadcast; of each statistic these are fewer
FIELDS = ["word_count", "line_count", "mean_word_length", "special_char_ratio", "empty_line_ratio", "words_per_line", "words_per_page", "ended_line_share", "common_word_share", "telling_word_share", "digit_ratio", "list_share", "table_share", "junk_share", "prose_share"]


def _measure(text: str) -> list:
    lines = text.split("\n")
    solid = [x for x in lines if x.strip()]
    size = dict.fromkeys(("list", "table", "junk", "prose", ""), 0)
    ended, fenced, phrases, flowing = 0, False, 0, 0
    for x in [*lines, ""]:
        t = x.strip()
        if not t:  # the end of a paragraph settles whether its phrases are wrapped prose
            size["prose" if flowing > 0.3 * phrases else "list"] += phrases
            phrases, flowing = 0, 0
            continue
        ended += bool(_END.search(t))
        if _FENCE.match(x):
            fenced = not fenced
            continue
        kind = line_kind(x)
        if kind == "phrase":
            phrases += len(t)
        else:
            flowing += len(t) if kind == "prose" else 0
            size[kind] += len(t)
    total = sum(size.values()) - size[""] or 1
    words = text.split()
    n, chars = len(words), len(text)
    low = text.lower().split()
    by = {k: sum(map(v.__contains__, low)) for k, v in _COMMON.items()}
    lang = max(by, key=by.get)
    share = by[lang] / (n or 1)
    kept = sum(map(len, words))
    alnum = sum(map(len, _ALNUM.findall(text)))
    digits = sum(map(len, _DIGITS.findall(text)))
    return [
        lang if share >= 0.1 else None, n, len(lines), kept / (n or 1), max(0, kept - alnum) / (chars or 1), 1 - len(solid) / len(lines), n / (len(solid) or 1),
        float(n) / max(1, n // WORDS_A_PAGE), ended / (len(solid) or 1), share, sum(map((_COMMON[lang] & _TELLING).__contains__, low)) / (n or 1), digits / (chars or 1), size["list"] / total, size["table"] / total, size["junk"] / total, size["prose"] / total,
    ]


def text_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, language, FIELDS): one row a document row. Null text counts as empty; an empty text has ratios of 0
    (empty_line_ratio 1). ``language`` is the one whose function words are most frequent, null if they are few."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_measure(t if isinstance(t, str) else "") for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["language", *FIELDS])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, language string, word_count long, line_count long, " + ", ".join(f"{f} double" for f in FIELDS[2:]))


def tail_probabilities(stats: DataFrame, statistics: dict[str, int] = STATISTICS) -> DataFrame:
    """(language, statistic, value, tail, size, n) for every different value: the share of the ``size`` reference texts of
    the language, and the text itself, whose value is at least (or at most) as far out; n rows have it."""
    language = F.coalesce("language", F.lit("")).alias("language")
    core = (F.col("language") != "") & (F.col("telling_word_share") >= REFERENCE)
    fields = list(dict.fromkeys(["telling_word_share", *statistics]))
    texts = stats.select(language, *fields).groupBy("language", *fields).agg(F.count("*").alias("rows"))
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.lit(d).alias("side"), (F.col(s) * d).alias("key")) for s, d in statistics.items()])).alias("c")
    counts = texts.select("language", core.cast("long").alias("core"), "rows", cells).groupBy("language", "c.statistic", "c.side", "c.key").agg(F.sum("core").alias("core"), F.sum("rows").alias("n"))
    # texts without a language, or of one without reference, are held against the reference of all
    some = counts.groupBy("language").agg(F.sum("core").alias("core")).where("core > 0").select("language")
    every = counts.groupBy(F.lit("").alias("language"), "statistic", "side", "key").agg(F.sum("core").alias("core"), F.sum("n").alias("n"))
    counts = counts.join(F.broadcast(some), "language", "left_semi").select("language", "statistic", "side", "key", "core", "n").unionByName(every)
    # far values first, so that the running total is the tail; equal keys are one row
    parts = cut_lineage(counts.repartitionByRange("language", "statistic", F.desc("key")).sortWithinPartitions("language", "statistic", F.desc("key")).withColumn("part", F.spark_partition_id()))
    # partitions times languages times statistics: small whatever the number of rows
    totals = parts.groupBy("part", "language", "statistic").agg(F.sum("core").alias("core")).toPandas()
    totals = totals.sort_values("part", kind="stable")
    totals["before"] = totals.groupby(["language", "statistic"])["core"].cumsum() - totals["core"]
    before = {(p, lang, s): b for p, lang, s, b in totals[["part", "language", "statistic", "before"]].itertuples(index=False)}
    size = totals.groupby(["language", "statistic"])["core"].sum().to_dict()

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int] = {}
        for pdf in batches:
            tail = np.empty(len(pdf))
            for (part, lang, s), at in pdf.groupby(["part", "language", "statistic"], sort=False).indices.items():
                running = np.cumsum(pdf["core"].to_numpy()[at]) + seen.get((part, lang, s), before[part, lang, s])
                seen[part, lang, s] = int(running[-1])
                tail[at] = (running + 1) / (size[lang, s] + 1)
            yield pd.DataFrame({"language": pdf["language"], "statistic": pdf["statistic"], "value": pdf["key"] * pdf["side"], "tail": tail, "size": [size[k] for k in zip(pdf["language"], pdf["statistic"], strict=True)], "n": pdf["n"]})

    return parts.mapInPandas(rank, "language string, statistic string, value double, tail double, size long, n long")


def outlier_scores(stats: DataFrame, statistics: dict[str, int] = STATISTICS) -> DataFrame:
    """``stats`` with ``outlier_score``, the sum over the statistics of -ln of the tail probability of the row's value, and
    ``attainable``, the largest such sum that the reference allows."""
    tails = cut_lineage(tail_probabilities(stats, statistics))
    rows = cut_lineage(stats.withColumn("__row", F.monotonically_increasing_id()))
    told = [r.language for r in tails.select("language").distinct().collect()]  # languages that have a reference
    language = F.when(F.col("language").isin(told), F.col("language")).otherwise("")
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in statistics])).alias("c")
    cells = rows.select("__row", language.alias("language"), cells).select("__row", "language", "c.*")
    on, most = ["language", "statistic", "value"], rows.count() / HEAVY
    heavy = F.broadcast(tails.where(F.col("n") > most).select(*on, "tail", "size"))  # fewer than 2 * HEAVY rows a statistic
    light = tails.where(F.col("n") <= most).select(*on, "tail", "size")
    scored = cells.join(heavy, on).unionByName(cells.join(heavy, on, "left_anti").join(light, on))
    scores = scored.groupBy("__row").agg(F.sum(-F.log("tail")).alias("outlier_score"), F.sum(F.log1p("size")).alias("attainable"))
    return rows.join(scores, "__row").drop("__row")


def kinds(stats: DataFrame) -> DataFrame:
    """(doc_id, kind, outlier_score) of the rows of ``stats`` that are no prose.

    Lines name the kind by their length; headings and code fences count for nothing. Of equal shares, junk comes before
    table before list. Rows are judged one by one, so repeated doc_ids give repeated rows. Empty texts are no case. Where
    there is no reference at all, most of a text's lines decide.
    """
    other = F.col("list_share") + F.col("table_share") + F.col("junk_share")
    top = F.greatest("list_share", "table_share", "junk_share")
    kind = F.when(F.col("junk_share") == top, "junk").when(F.col("table_share") == top, "table").otherwise("list")
    far = (F.col("attainable") > 0) & (F.col("outlier_score") >= F.least(F.lit(OUTLIER), ATTAINED * F.col("attainable"))) & (other > NAMED)
    alone = (F.col("attainable") == 0) & (other > 0.5)
    return outlier_scores(stats).where(far | alone).select("doc_id", kind.alias("kind"), "outlier_score")


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_scores(cut_lineage(text_statistics(read_table(spark, sf_dir, "documents")))).drop("attainable")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(cut_lineage(text_statistics(read_table(spark, sf_dir, "documents")))).select("doc_id", "kind")
