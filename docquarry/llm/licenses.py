"""Licences of files, from their texts and from the directories above them.

Three kinds of templates are compared with files by the cosine of sparse TF-IDF vectors.
*Headers* declare a licence anywhere: a window of as many terms as the template, over line ends,
matches from ``MIN_COSINE`` on.  *Titles* open long licences: such a window within the first
``HEAD_TERMS`` terms and from ``MIN_TITLE`` on makes the file that licence's text, elsewhere it is a
header.  *Whole* licences are compared with the whole file, which is the licence's text from
``MIN_WHOLE`` on.  Document frequencies of all terms are counted over the whole corpus, so that
weights follow shares of documents and not their number.

Few files can match.  Of each template the heaviest terms are its anchors: as many as it takes
for the others' weight to stay under the least cosine, so a text without an anchor cannot reach it
(Cauchy-Schwarz).  Only files with an anchor are cut into terms, and windows are laid so that an
anchor of the file lies on the same one of the template.  A window or file that shares too little
of the template's weight with it goes by the same bound.  Templates and their terms are bounded by the
template list and are broadcast; the frequencies of other terms are joined by a shuffle.

A file that is a licence's text, or that has windows over at least ``min_share`` of its words, is a
licence file and governs its directory.  A file without a match takes the licence of the nearest
directory above it that has one: directories, not files, are joined to their ancestors, and the files
then to their directory.

Defined cases: NULL and empty texts have no match and may inherit; a file's licence is that
of a licence's text first, then of the highest cosine, the longest template, the first in the list;
two licence files in one directory: the higher cosine, then the smaller path; a NULL path lies in the
root; rows that repeat id and text are one file; an empty table gives an empty result.  Only id,
text and path are read.
"""

from __future__ import annotations

import itertools
import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import settle
from docquarry.llm.licence_texts import TEMPLATES

MIN_COSINE = 0.6
MIN_TITLE = 0.8
MIN_WHOLE = 0.85
HEAD_TERMS = 24
DIGITS = 9
SLACK = 1e-6


def least_of(kind: str) -> float:
    return MIN_WHOLE if kind == "whole" else MIN_COSINE


def terms_of(text: Column) -> Column:
    """Runs of a-z and 0-9, repeats included."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _template_terms() -> list[list[str]]:
    return [re.findall("[a-z0-9]+", t.wording.lower()) for t in TEMPLATES]


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, n): in how many rows of column ``text`` each term is, for all terms."""
    return (
        texts.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )


def term_weights(frequencies: DataFrame, total: int) -> dict[str, float]:
    """Inverse document frequency of each template term."""
    vocabulary = sorted({t for terms in _template_terms() for t in terms})
    known = {r["term"]: r["n"] for r in frequencies.filter(F.col("term").isin(vocabulary)).collect()}
    return {t: math.log((1 + total) / (1 + known.get(t, 0))) + 1 for t in vocabulary}


def template_vectors(weights: dict[str, float]) -> list[dict[str, float]]:
    """Unit TF-IDF vectors."""
    vectors = []
    for terms in _template_terms():
        raw = {t: terms.count(t) * weights[t] for t in terms}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / norm for t, w in raw.items()})
    return vectors


def anchors(vectors: list[dict[str, float]]) -> list[set[str]]:
    """Per template, terms of which every text that reaches its least cosine has one."""
    found = []
    for template, vector in zip(TEMPLATES, vectors):
        least, rest, own = least_of(template.kind), 1.0, set()
        for term, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if math.sqrt(max(rest, 0.0)) < least - SLACK:
                break
            own.add(term)
            rest -= weight * weight
        found.append(own)
    return found


def _any_of(terms: set[str]) -> str:
    """A pattern for one of the terms, by first letter, so that most places are left at once."""
    groups = [
        first + "(?:" + "|".join(t[1:] for t in same) + ")"
        for first, same in itertools.groupby(sorted(terms), key=lambda t: t[0])
    ]
    return rf"(?<![a-z0-9])(?:{'|'.join(groups)})(?![a-z0-9])"


def _fixed(value, kind: str) -> Column:
    """A bounded table as one constant."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _windows(marks: list[set[str]]) -> Column:
    """Windows (n, at, words) of column ``terms`` that have an anchor where template ``n`` has it."""
    places: dict[str, list] = {}
    lengths = []
    for n, (template, own) in enumerate(zip(_template_terms(), marks)):
        lengths.append(len(template))
        if TEMPLATES[n].kind != "whole":
            for at, term in enumerate(template):
                if term in own:
                    places.setdefault(term, []).append({"n": n, "o": at})
    by_term = _fixed(places, "map<string,array<struct<n:int,o:int>>>")
    listed = ", ".join(f"'{t}'" for t in sorted(places))
    seen = F.expr(f"filter(transform(terms, (t, i) -> struct(t, i)), x -> x.t IN ({listed}))")
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                seen,
                lambda x: F.transform(
                    F.try_element_at(by_term, x["t"]),
                    lambda y: F.struct(y["n"].alias("n"), F.greatest(x["i"] - y["o"], F.lit(0)).alias("at")),
                ),
            )
        )
    )
    size = _fixed(lengths, "array<int>")
    return F.transform(
        starts,
        lambda s: F.struct(
            s["n"].alias("n"), s["at"].alias("at"), F.slice("terms", s["at"] + 1, size[s["n"]]).alias("words")
        ),
    )


def _units(vectors: list[dict[str, float]], marks: list[set[str]]) -> Column:
    """Windows and, for whole licences, files, that share enough of their template's weight."""
    whole = _fixed([n for n, t in enumerate(TEMPLATES) if t.kind == "whole"], "array<int>")
    files = F.transform(
        whole, lambda n: F.struct(n.alias("n"), F.lit(0).alias("at"), F.col("terms").alias("words"))
    )
    squares = _fixed([{t: w * w for t, w in v.items()} for v in vectors], "array<map<string,double>>")
    vocabulary = _fixed([sorted(v) for v in vectors], "array<array<string>>")
    least = _fixed([least_of(t.kind) ** 2 - SLACK for t in TEMPLATES], "array<double>")

    def shares_enough(unit: Column) -> Column:
        shared = F.aggregate(
            F.array_intersect(unit["words"], vocabulary[unit["n"]]),
            F.lit(0.0),
            lambda total, t: total + F.coalesce(F.try_element_at(squares[unit["n"]], t), F.lit(0.0)),
        )
        return shared >= least[unit["n"]]

    return F.filter(F.concat(_windows(marks), files), shares_enough)


def licence_matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, n, at, words, cosine): each window or file that reaches template ``n``."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")
    )
    total = rows.count()
    frequencies = settle(document_frequencies(rows), "term-frequencies")
    weights = term_weights(frequencies, total)
    vectors = template_vectors(weights)
    marks = anchors(vectors)
    unit = ["doc_id", "th", "n", "at"]
    units = (
        rows.filter(F.lower("text").rlike(_any_of(set().union(*marks))))
        .select("doc_id", "th", terms_of(F.col("text")).alias("terms"))
        .select("doc_id", "th", F.explode(_units(vectors, marks)).alias("u"))
        .select("doc_id", "th", "u.n", "u.at", F.size("u.words").alias("words"), F.explode("u.words").alias("term"))
    )
    table = spark.createDataFrame(
        [(term, weight, [v.get(term, 0.0) for v in vectors]) for term, weight in sorted(weights.items())],
        "term string, weight double, templates array<double>",
    )
    counted = settle(
        units.groupBy(*unit, "words", "term").agg(F.count("*").alias("tf")).join(
            F.broadcast(table), "term", "left"
        ).select(
            *unit, "words", "term", "tf", "weight", F.coalesce(F.col("templates")[F.col("n")], F.lit(0.0)).alias("t")
        ),
        "licence-terms",
    )
    # Terms of the templates carry their weight already; the vocabulary of the others grows with
    # the corpus and is dealt by term, not sent to every task.
    idf = F.log(F.lit(1.0 + total) / (1 + F.col("n_docs"))) + 1
    others = counted.filter("weight IS NULL").join(
        frequencies.withColumnRenamed("n", "n_docs").hint("shuffle_merge"), "term"
    )
    weighed = counted.filter("weight IS NOT NULL").withColumn("w", F.col("tf") * F.col("weight")).select(
        *unit, "words", "t", "w"
    ).unionByName(others.withColumn("w", F.col("tf") * idf).select(*unit, "words", "t", "w"))
    least = _fixed([least_of(t.kind) for t in TEMPLATES], "array<double>")
    return (
        weighed.groupBy(*unit)
        .agg(
            F.first("words").alias("words"),
            F.round(F.sum(F.col("w") * F.col("t")) / F.sqrt(F.sum(F.col("w") * F.col("w"))), DIGITS).alias("cosine"),
        )
        .filter(F.col("cosine") >= least[F.col("n")])
    )


def own_licences(matches: DataFrame) -> DataFrame:
    """(d, t, own, cosine, is_text, licence_words) of every file with a match."""
    names = _fixed([t.name for t in TEMPLATES], "array<string>")
    kinds = _fixed([t.kind for t in TEMPLATES], "array<string>")
    lengths = _fixed([len(terms) for terms in _template_terms()], "array<int>")
    number = F.col("n")
    kind = kinds[number]
    opens = (kind == "title") & (F.col("at") < HEAD_TERMS) & (F.col("cosine") >= MIN_TITLE)
    covered = F.when(kind != "whole", F.sequence(F.col("at"), F.col("at") + F.col("words") - 1))
    best = F.max(
        F.struct(
            ((kind == "whole") | opens).alias("is_text"),
            F.col("cosine").alias("cosine"),
            lengths[number].alias("length"),
            (-number).alias("minus"),
        )
    )
    return (
        matches.groupBy("doc_id", "th")
        .agg(best.alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list(covered)))).alias("licence_words"))
        .select(
            F.col("doc_id").alias("d"),
            F.col("th").alias("t"),
            names[-F.col("best.minus")].alias("own"),
            F.col("best.cosine").alias("cosine"),
            F.col("best.is_text").alias("is_text"),
            "licence_words",
        )
    )


def _directory(path: Column) -> Column:
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def governing(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, inherited, inherited_from) of the directories with a licensed one at or above them."""
    parts = F.split("dir", "/")
    above = directories.select(
        "dir",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array(F.lit("")),
                    F.transform(
                        F.sequence(F.lit(1), F.size(parts)),
                        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
                    ),
                )
            )
        ).alias("up"),
    )
    return (
        above.join(licensed.withColumnRenamed("dir", "up"), "up")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("up").alias("depth"), "up", "licence")).alias("near"))
        .select("dir", F.col("near.licence").alias("inherited"), F.col("near.up").alias("inherited_from"))
    )


def scan_licences(
    docs: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_share: float = 0.5,
) -> DataFrame:
    """(doc_id, path, own, cosine, licence_file, inherited, inherited_from, licence) of every file."""
    found = settle(own_licences(licence_matches(docs, id_col, text_col)), "licences")
    files = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("th"),
        path.alias("path"),
        F.coalesce(F.size(terms_of(F.col(text_col))), F.lit(0)).alias("words"),
    ).dropDuplicates(["doc_id", "th", "path"])
    files = settle(
        files.join(found, files["doc_id"].eqNullSafe(found["d"]) & (files["th"] == found["t"]), "left").select(
            "doc_id",
            "path",
            _directory(F.col("path")).alias("dir"),
            "own",
            "cosine",
            F.coalesce(
                F.col("is_text") | (F.col("licence_words") >= F.col("words") * F.lit(min_share)), F.lit(False)
            ).alias("licence_file"),
        ),
        "licensed-files",
    )
    licensed = (
        files.filter("licence_file")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own")).alias("first"))
        .select("dir", F.col("first.own").alias("licence"))
    )
    # Written, so that a directory with a third of all files can be split in the join.
    near = settle(governing(files.select("dir").distinct(), licensed), "inherited-licences")
    takes = F.col("own").isNull()
    return files.join(near, "dir", "left").select(
        "doc_id",
        "path",
        "own",
        "cosine",
        "licence_file",
        F.when(takes, F.col("inherited")).alias("inherited"),
        F.when(takes, F.col("inherited_from")).alias("inherited_from"),
        F.coalesce("own", "inherited").alias("licence"),
    )
