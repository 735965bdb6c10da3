"""Filter rules as boolean Columns, and the engine that folds them with AND.

A rule never yields null, so kept and removed rows are each other's complement.
Comparisons stay bare (``x IS NOT NULL AND x >= n`` rather than a ``coalesce``),
so that they reach a Parquet scan. Rules are cheap to dear: Catalyst keeps the
order of a conjunction. It evaluates Python functions, and what they are given,
for every row whatever the conjunction says, so the engine hands the texts that
are searched to the search only where the cheap rules hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.doi import doi_key
from quire.functions.text import normalize_plain, normalize_text, strip
from quire.tables import counted

QUARTILES = ("Q1", "Q2", "Q3", "Q4", "-")
#: DOI lists longer than this are joined instead of written into the plan.
IN_LIST = 1000


@dataclass(frozen=True)
class Rule:
    """Subclasses return a non-null boolean Column over the paper columns."""

    name = "rule"

    def column(self) -> Column:
        raise NotImplementedError

    def column_where(self, passed: Column) -> Column:
        """``column()`` where ``passed`` holds; elsewhere anything, null too."""
        return self.column()

    def prepare(self, papers: DataFrame) -> DataFrame:
        """``papers`` with the helper columns that ``column()`` reads, if any; their names start with ``_rule``."""
        return papers

    def to_dict(self) -> dict[str, Any]:
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        shown = lambda v: sorted(v) if isinstance(v, (set, frozenset)) else "(table)" if isinstance(v, DataFrame) else v
        return {"name": self.name} | {k: shown(v) for k, v in values.items()}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _flag(name: str) -> Column:
    return F.col(name).eqNullSafe(True)


@dataclass(frozen=True)
class YearRule(Rule):
    """Inclusive bounds; papers without a year go."""

    min_year: int | None = None
    max_year: int | None = None
    name = "year"

    def column(self) -> Column:
        keep = F.col("year").isNotNull()
        if self.min_year is not None:
            keep = keep & (F.col("year") >= self.min_year)
        if self.max_year is not None:
            keep = keep & (F.col("year") <= self.max_year)
        return keep


@dataclass(frozen=True)
class CitationRule(Rule):
    min_citations: int = 0
    name = "citations"

    def column(self) -> Column:
        if self.min_citations <= 0:
            return F.coalesce(F.col("cited_by_count"), F.lit(0)) >= self.min_citations
        return F.col("cited_by_count").isNotNull() & (F.col("cited_by_count") >= self.min_citations)


@dataclass(frozen=True)
class IndexedRule(Rule):
    name = "scopus_only"

    def column(self) -> Column:
        return _flag("scopus_indexed")


@dataclass(frozen=True)
class QuartileRule(Rule):
    """Unranked journals (``-``) follow ``include_unranked`` whatever the allowed set."""

    allowed: frozenset[str] = frozenset(QUARTILES[:4])
    include_unranked: bool = True
    name = "quartile"

    def column(self) -> Column:
        q = F.upper(strip(_text("quartile")))
        ranked = sorted(set(self.allowed) & set(QUARTILES[:4]))
        return F.when(q == "-", F.lit(self.include_unranked)).otherwise(q.isin(*ranked) if ranked else F.lit(False))


#: Keywords that are looked for one by one; more go into an automaton, whose time does not grow with their number.
CONTAINS = 32


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether a text contains any of many keywords: one run of an automaton, built once a task, over Arrow batches."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in keywords:
            automaton.add_word(word)
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: t is not None and next(automaton.iter(t), None) is not None).astype(bool)

    search.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, "boolean")(text)


@dataclass(frozen=True)
class KeywordRule(Rule):
    """Substring search in the normalised title, abstract and keywords together.

    Keywords that normalise to nothing (no Latin letters or digits) are found
    everywhere, as an empty string is; ``ignore_empty`` leaves them out instead.
    """

    keywords: tuple[str, ...] = ()
    fields: tuple[str, ...] = ("title", "abstract", "keywords")
    ignore_empty: bool = False
    compose: bool = True

    def column(self) -> Column:
        return self.column_where(None)

    def found(self, passed: Column | None = None) -> Column | None:
        """Whether any keyword is found; None if there are none to look for. Texts are searched where ``passed`` holds, if it is given."""
        wanted = list(dict.fromkeys(normalize_plain(k.lower()) for k in self.keywords))
        wanted = [w for w in wanted if w or not self.ignore_empty]
        if not wanted:
            return None
        parts = [F.array_join(F.coalesce(F.col(f), F.array().cast("array<string>")), " ") if f in ("keywords", "authors", "subjects", "issns") else _text(f) for f in self.fields]
        if "" in wanted:
            return F.lit(True)
        text = F.concat_ws(" ", *parts)
        text = normalize_text(text if passed is None else F.when(passed, text), self.compose)
        if len(wanted) > CONTAINS:
            return any_keyword(text, wanted)
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in wanted])


@dataclass(frozen=True)
class KeywordBlacklist(KeywordRule):
    name = "exclude_keywords"

    def column_where(self, passed: Column | None) -> Column:
        found = self.found(passed)
        return F.lit(True) if found is None else ~found


@dataclass(frozen=True)
class KeywordWhitelist(KeywordRule):
    name = "include_keywords"

    def column_where(self, passed: Column | None) -> Column:
        found = self.found(passed)
        return F.lit(True) if found is None else found


@dataclass(frozen=True)
class OpenAccessRule(Rule):
    name = "open_access_only"

    def column(self) -> Column:
        return _flag("is_open_access")


@dataclass(frozen=True)
class LanguageRule(Rule):
    """The paper's language is lower-cased, the allowed ones are taken as given; unknown languages stay."""

    allowed: frozenset[str] = frozenset({"en"})
    name = "language"

    def column(self) -> Column:
        return (_text("language") == "") | (F.lower(_text("language")).isin(*sorted(self.allowed)) if self.allowed else F.lit(False))


@dataclass(frozen=True, eq=False)
class DoiRule(Rule):
    """Whether a paper's DOI is listed. ``dois`` are keys, or a table with DOIs in its first column.

    Tables, and more than ``IN_LIST`` keys, are joined; ``prepare`` then marks the papers.
    """

    dois: frozenset[str] | DataFrame = frozenset()

    @property
    def _mark(self) -> str:
        return f"_rule_{self.name}"

    @property
    def _joined(self) -> bool:
        return isinstance(self.dois, DataFrame) or len(self.dois) > IN_LIST

    def prepare(self, papers: DataFrame) -> DataFrame:
        if not self._joined:
            return papers
        table = self.dois if isinstance(self.dois, DataFrame) else papers.sparkSession.createDataFrame([(d,) for d in sorted(self.dois)], "doi string")
        keys = counted(_doi_keys(table).select(F.col("_key").alias(f"{self._mark}_key"), F.lit(True).alias(self._mark)), "dois")
        return papers.join(keys, (_text("doi") != "") & (doi_key(_text("doi")) == F.col(f"{self._mark}_key")), "left")

    def listed(self) -> Column:
        return F.col(self._mark).isNotNull() if self._joined else doi_key(_text("doi")).isin(*sorted(self.dois))


@dataclass(frozen=True, eq=False)
class DoiBlacklist(DoiRule):
    name = "exclude_dois"

    def column(self) -> Column:
        return (_text("doi") == "") | ~self.listed() if self._joined or self.dois else F.lit(True)


@dataclass(frozen=True, eq=False)
class DoiWhitelist(DoiRule):
    """An empty list of keys keeps all papers."""

    name = "include_dois"

    def column(self) -> Column:
        return (_text("doi") != "") & self.listed() if self._joined or self.dois else F.lit(True)


@dataclass(frozen=True)
class PredicateRule(Rule):
    """An opaque Python predicate over a batch of rows; the slow way out."""

    predicate: Callable[[pd.DataFrame], pd.Series]
    columns: tuple[str, ...]
    name = "predicate"

    def column(self) -> Column:
        test = self.predicate

        def run(rows: pd.DataFrame) -> pd.Series:
            return test(rows).astype(bool)

        run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
        return F.coalesce(F.pandas_udf(run, "boolean")(F.struct(*self.columns)), F.lit(False))


@dataclass
class FilterEngine:
    """Rules joined by AND."""

    rules: list[Rule] = field(default_factory=list)

    def add(self, rule: Rule) -> FilterEngine:
        self.rules.append(rule)
        return self

    def column(self) -> Column:
        both = lambda a, b: a & b
        cheap = [r.column() for r in self.rules if not isinstance(r, (KeywordRule, PredicateRule))]
        # a conjunction with a false side is false whatever the other one is
        passed = reduce(both, cheap) if cheap else None
        return reduce(both, [r.column() if passed is None else r.column_where(passed) for r in self.rules], F.lit(True))

    def mark(self, papers: DataFrame) -> DataFrame:
        """``papers`` with ``_keep``: one pass for both sides."""
        marked = reduce(lambda df, r: r.prepare(df), self.rules, papers).withColumn("_keep", self.column())
        return marked.select(*papers.columns, "_keep")

    def apply(self, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(kept, removed), in the order of the input where that is sorted by ``_pos``."""
        marked = self.mark(papers)
        return marked.where("_keep").drop("_keep"), marked.where("NOT _keep").drop("_keep")

    def describe(self) -> list[dict[str, Any]]:
        return [r.to_dict() for r in self.rules]


def _doi_keys(dois: DataFrame) -> DataFrame:
    return dois.select(doi_key(F.coalesce(F.col(dois.columns[0]), F.lit(""))).alias("_key")).distinct()


def include_dois(papers: DataFrame, dois: DataFrame) -> DataFrame:
    """Papers whose DOI is in a table of DOIs (its first column): the join form of ``DoiWhitelist``."""
    named = papers.where(_text("doi") != "")
    return named.join(_doi_keys(dois), doi_key(named["doi"]) == F.col("_key"), "left_semi")


def exclude_dois(papers: DataFrame, dois: DataFrame) -> DataFrame:
    """Papers without a DOI, or whose DOI is not in a table of DOIs."""
    keys = _doi_keys(dois)
    return papers.join(keys, (_text("doi") != "") & (doi_key(papers["doi"]) == F.col("_key")), "left_anti")


def split_csv(value: str | None) -> list[str]:
    return [v.strip() for v in (value or "").split(",") if v.strip()]


def build_engine(
    *,
    min_year: int | None = None,
    max_year: int | None = None,
    min_citations: int | None = None,
    scopus_only: bool = False,
    quartile: str | None = None,
    include_unranked: bool = True,
    exclude_keywords: str | None = None,
    include_keywords: str | None = None,
    open_access_only: bool = False,
    language: str | None = None,
    exclude_dois: Iterable[str] | DataFrame | None = None,
    include_dois: Iterable[str] | DataFrame | None = None,
    compose: bool = True,
) -> FilterEngine:
    """The engine of a set of flags; flags that say nothing add no rule. DOIs come as texts or as a table."""
    keys = lambda dois: dois if isinstance(dois, DataFrame) else frozenset(d.lower().strip() for d in dois or ())
    engine = FilterEngine()
    if min_year is not None or max_year is not None:
        engine.add(YearRule(min_year, max_year))
    if (min_citations or 0) > 0:
        engine.add(CitationRule(min_citations))
    if scopus_only:
        engine.add(IndexedRule())
    wanted = split_csv((quartile or "").upper())
    if "ALL" not in wanted and (allowed := frozenset(wanted) & frozenset(QUARTILES)):
        engine.add(QuartileRule(allowed, include_unranked))
    if open_access_only:
        engine.add(OpenAccessRule())
    if language:
        engine.add(LanguageRule(frozenset(split_csv(language))))
    for kind, dois in ((DoiBlacklist, exclude_dois), (DoiWhitelist, include_dois)):
        if isinstance(listed := keys(dois), DataFrame) or listed:
            engine.add(kind(listed))
    if exclude_keywords:
        engine.add(KeywordBlacklist(tuple(split_csv(exclude_keywords)), compose=compose))
    if include_keywords:
        engine.add(KeywordWhitelist(tuple(split_csv(include_keywords)), compose=compose))
    return engine
