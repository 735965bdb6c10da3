"""Text sinks: one text column a paper, a header, and an ordered writer.

Each format is an expression over the paper columns, so entries are made in
parallel; only writing one ordered file is sequential.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.paper import citation_key, pages, short_authors
from quire.functions.text import strip, truncate_ellipsis
from quire.schema import PAPER_FIELDS
from quire.sinks.source import write_single, write_text
from quire.tables import materialise, new_path, number_rows

_FIELDS = [n for n, _, _ in PAPER_FIELDS]


def _lines(*lines: Column) -> Column:
    """Lines that are not null, joined."""
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def _if(value: Column, line: Column) -> Column:
    return F.when(value, line)


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _some(name: str) -> Column:
    return F.size(name) > 0


def _year() -> Column:
    return F.coalesce(F.col("year"), F.lit(0)) != 0


def _bool(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)).cast("string")


def bibtex_escape(text: Column) -> Column:
    """Escapes the characters that BibTeX reads as markup."""
    aside = F.translate(text, "\\", "\x01")
    marked = F.regexp_replace(aside, r"([{}&%$#_])", r"\\$1")
    hats = F.replace(F.replace(marked, F.lit("^"), F.lit("\\^{}")), F.lit("~"), F.lit("\\~{}"))
    return F.replace(hats, F.lit("\x01"), F.lit("\\textbackslash{}"))


def bibtex_entry(index: Column) -> Column:
    """An ``@article`` entry; ``index`` (from 0) marks papers without a DOI."""
    line = lambda name, value: F.concat(F.lit(f"  {name:<12} = {{"), value, F.lit("}"))
    esc = lambda name: bibtex_escape(F.col(name))
    page = pages(F.col("first_page"), F.col("last_page"))
    rows = [
        _if(_some("authors"), line("author", bibtex_escape(F.array_join("authors", " and ")))),
        _if(_given("title"), line("title", esc("title"))),
        _if(_given("journal"), line("journal", esc("journal"))),
        _if(_year(), line("year", F.col("year").cast("string"))),
        _if(_given("month"), line("month", F.col("month"))),
        _if(_given("volume"), line("volume", F.col("volume"))),
        _if(_given("issue"), line("number", F.col("issue"))),
        _if(page != "", line("pages", bibtex_escape(page))),
        _if(_given("doi"), line("doi", F.col("doi"))),
        _if(_given("publisher"), line("publisher", esc("publisher"))),
        _if(_given("issn_electronic"), line("issn", F.col("issn_electronic"))),
        _if(_given("url"), line("url", F.col("url"))),
        _if(_given("abstract"), line("abstract", bibtex_escape(truncate_ellipsis(F.col("abstract"), 1500)))),
        _if(_some("keywords"), line("keywords", bibtex_escape(F.array_join("keywords", ", ")))),
        line("scopus_indexed", _bool("scopus_indexed")),
        _if(_given("quartile"), line("quartile", F.col("quartile"))),
    ]
    body = F.array_join(F.filter(F.array(*rows), lambda x: x.isNotNull()), ",\n")
    key = citation_key(F.col("authors"), F.col("year"), F.col("pub_date"), F.col("doi"), index)
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}\n"))


def ris_entry() -> Column:
    row = lambda tag, name: _if(_given(name), F.concat(F.lit(f"{tag}  - "), F.col(name)))
    each = lambda tag, name: _if(_some(name), F.array_join(F.transform(name, lambda x: F.concat(F.lit(f"{tag}  - "), x)), "\n"))
    abstract = truncate_ellipsis(strip(F.replace(F.col("abstract"), F.lit("\n"), F.lit(" "))), 2000)
    quartile = F.when(_given("quartile"), F.col("quartile")).otherwise(F.lit("N/A"))
    return _lines(
        F.lit("TY  - JOUR"),
        each("AU", "authors"),
        row("TI", "title"),
        row("JO", "journal"),
        row("PB", "publisher"),
        _if(_year(), F.concat(F.lit("PY  - "), F.col("year").cast("string"))),
        row("VL", "volume"),
        row("IS", "issue"),
        row("SP", "first_page"),
        row("EP", "last_page"),
        row("DO", "doi"),
        _if(_given("abstract"), F.concat(F.lit("AB  - "), abstract)),
        row("SN", "issn_electronic"),
        row("UR", "url"),
        each("KW", "keywords"),
        F.concat(F.lit("N1  - scopus_indexed="), _bool("scopus_indexed"), F.lit("; quartile="), quartile),
        F.lit("ER  -"),
        F.lit(""),
    )


CSV_COLUMNS = ("doi", "title", "authors", "journal", "year", "publisher", "volume", "issue", "pages", "issn", "cited_by_count", "is_open_access", "open_access_url", "scopus_indexed", "quartile", "language", "source", "url", "keywords", "abstract_truncated")


def csv_columns() -> list[Column]:
    """The 20 columns as text."""
    values = {
        "authors": F.array_join("authors", "; "),
        "year": F.when(_year(), F.col("year").cast("string")).otherwise(F.lit("")),
        "pages": pages(F.col("first_page"), F.col("last_page")),
        "issn": F.when(_given("issn_electronic"), F.col("issn_electronic")).otherwise(F.col("issn_print")),
        "cited_by_count": F.col("cited_by_count").cast("string"),
        "is_open_access": _bool("is_open_access"),
        "scopus_indexed": _bool("scopus_indexed"),
        "keywords": F.array_join("keywords", "; "),
        "abstract_truncated": truncate_ellipsis(F.col("abstract"), 200),
    }
    return [values.get(c, F.col(c)).alias(c) for c in CSV_COLUMNS]


def csv_entry() -> Column:
    """A row with every value quoted."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in csv_columns()]
    return F.concat_ws(",", *quoted)


def jsonl_entry() -> Column:
    """One JSON object with all fields, nulls kept."""
    return F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"})


def markdown_entry(number: Column) -> Column:
    """A numbered entry (from 1)."""
    head = F.concat(
        F.lit("## "),
        number.cast("string"),
        F.lit(". "),
        F.when(_given("doi"), F.concat(F.lit("`"), F.col("doi"), F.lit("`"))).otherwise(F.lit("_(no DOI)_")),
        F.when(F.col("scopus_indexed"), F.concat(F.lit("  `[Scopus"), F.when(_given("quartile"), F.concat(F.lit(" "), F.col("quartile"))).otherwise(F.lit("")), F.lit("]`"))).otherwise(F.lit("")),
    )
    bold = lambda name, value: F.concat(F.lit(f"**{name}:** "), value)
    link = F.when(_given("open_access_url"), F.concat(F.lit(" — "), F.col("open_access_url"))).otherwise(F.lit(""))
    return _lines(
        head,
        F.lit(""),
        _if(_given("title"), bold("Title", F.col("title"))),
        _if(_some("authors"), bold("Authors", short_authors(F.col("authors")))),
        _if(_given("journal"), bold("Journal", F.concat(F.lit("*"), F.col("journal"), F.lit("*")))),
        _if(_year(), bold("Year", F.col("year").cast("string"))),
        _if(F.coalesce("cited_by_count", F.lit(0)) != 0, bold("Cited by", F.col("cited_by_count").cast("string"))),
        _if(F.col("is_open_access"), bold("Open Access", F.concat(F.lit("yes"), link))),
        _if(_given("abstract"), F.concat(F.lit("\n> "), truncate_ellipsis(F.col("abstract"), 500))),
        F.lit(""),
    )


def md_totals(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("total"), F.count_if("scopus_indexed").alias("indexed"), F.count_if(~F.col("scopus_indexed")).alias("not_indexed"))


@dataclass(frozen=True)
class Exporter:
    """A text format: ``entry`` makes a paper's text from its number (from 1), ``head`` the lines before all entries.

    ``numbered`` says whether entries read the number, ``ends`` whether the last line is closed.
    """

    format_name: str
    file_extension: str
    entry: Callable[[Column], Column]
    aliases: tuple[str, ...] = ()
    numbered: bool = False
    head: Callable[[DataFrame], list[str]] = lambda papers: []
    ends: bool = False

    def entries(self, papers: DataFrame) -> DataFrame:
        """Papers to (_pos, text)."""
        if self.numbered:
            papers = number_rows(papers)
        return papers.select("_pos", self.entry(F.col("_n")).alias("text"))

    def header(self, papers: DataFrame) -> list[str]:
        return self.head(papers)

    def export_to_file(self, papers: DataFrame, path: str | Path) -> Path:
        """One ordered UTF-8 file on the driver's disk; tasks write its parts, which are joined as bytes."""
        head = "\n".join(self.header(papers))
        rows = materialise(self.entries(papers), "entries")
        some = not rows.isEmpty()
        ends = "\n" if self.ends and (some or head) else ""
        return write_single(rows, Path(path), new_path(papers.sparkSession, "parts"), head=head + ("\n" if head and some else ""), tail=ends)

    def export_to_folder(self, papers: DataFrame, path: str) -> None:
        """Ordered part files for results of any size; the header is the first. A write that fails leaves none."""
        write_text(self.entries(papers), path, format_name=f"papers-{self.format_name}", overwrite=True, extension=self.file_extension, head="\n".join(self.header(papers)))


def _markdown_head(papers: DataFrame) -> list[str]:
    t = md_totals(papers).first()
    return ["# References", "", f"Total: {t['total']} entries  ", f"Scopus-indexed: {t['indexed']}  ", f"Non-Scopus: {t['not_indexed']}", "", "---", ""]


_exporters: dict[str, Exporter] = {}


def register_exporter(exporter: Exporter) -> Exporter:
    """Makes a format available to ``get_exporter`` under its name, extension and aliases; a later one replaces an earlier."""
    for alias in (exporter.format_name, exporter.file_extension, *exporter.aliases):
        _exporters[alias.lower().strip()] = exporter
    return exporter


register_exporter(Exporter("bibtex", ".bib", lambda n: bibtex_entry(n - 1), ("bib",), True, lambda papers: ["% Generated by quire", "% Format: BibTeX", "% All entries include the custom field `scopus_indexed`", ""]))
register_exporter(Exporter("ris", ".ris", lambda n: ris_entry()))
register_exporter(Exporter("csv", ".csv", lambda n: csv_entry(), head=lambda papers: [",".join(f'"{c}"' for c in CSV_COLUMNS)], ends=True))
register_exporter(Exporter("jsonl", ".jsonl", lambda n: jsonl_entry(), ("json",), ends=True))
register_exporter(Exporter("markdown", ".md", markdown_entry, ("md",), True, _markdown_head))


def get_exporter(name: str) -> Exporter:
    exporter = _exporters.get(name.lower().strip())
    if exporter is None:
        raise ValueError(f"unknown export format: {name}")
    return exporter


def flatten_source(sources: Iterable[DataFrame]) -> DataFrame:
    """Several lists of papers end to end: ``_pos`` runs on from list to list."""
    marked = [df.withColumn("_list", F.lit(i)) for i, df in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return number_rows(every.withColumn("_pos", F.struct("_list", "_pos")), "_n").withColumn("_pos", (F.col("_n") - 1).cast("bigint")).drop("_n", "_list")
