"""Papers as they come in: where an input leads, archives and e-prints as texts, and reference lists in layers."""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.idents import safe_id

#: What an archive is called, and the least length of a text of TeX and the most that is kept of a full text.
ARCHIVES = (".zip", ".tar.gz", ".tgz", ".tar")
TEX_CHARS, TEXT_CHARS = 500, 200_000


def parse_arxiv(c: Column) -> Column:
    """The first preprint number in an input, with its version; null without any."""
    return F.nullif(F.regexp_extract(c, r"([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)", 1), F.lit(""))


def route(source: Column, is_file: Column) -> Column:
    """struct(kind, paper_id): a local PDF, a local archive, a preprint, a URL; what is none of these is an error when it is read.

    is_file tells whether the input is an existing file. A URL leads to a preprint only at the preprint server.
    """
    s = F.trim(source)
    low = F.lower(s)
    archive = F.exists(F.array(*map(F.lit, ARCHIVES)), lambda e: low.endswith(e))
    http = low.rlike("^https?://")
    stem = F.regexp_extract(s, r"([^/]*?)(?:\.[^./]*)?$", 1)
    made = lambda kind, paper: F.struct(F.lit(kind).alias("kind"), paper.alias("paper_id"))
    message = F.concat(F.lit("Unrecognized input: '"), source, F.lit("' — expected a local PDF or .zip/.tar.gz, an arXiv id/URL, or an http(s) PDF URL"))
    return (
        F.when(is_file & low.endswith(".pdf"), made("pdf", safe_id(stem, s)))
        .when(is_file & archive, made("archive", safe_id(stem, s)))
        .when((~http | F.contains(low, F.lit("arxiv.org"))) & parse_arxiv(s).isNotNull(), made("arxiv", parse_arxiv(s)))
        .when(http, made("url", F.concat(F.lit("url-"), F.substring(F.sha1(s.cast("binary")), 1, 12))))
        .otherwise(F.struct(F.raise_error(message).cast("string").alias("kind"), F.lit(None).cast("string").alias("paper_id")))
    )


def sniff(content: Column) -> Column:
    """pdf, zip, gzip or other, by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head.startswith("504B03"), "zip").when(head.startswith("1F8B"), "gzip").otherwise("other")


def _inside(name: str) -> bool:
    """Whether a member's name stays in the folder that it is unpacked to."""
    return not posixpath.normpath(posixpath.join("/root", name)).startswith("..") and posixpath.normpath(posixpath.join("root", name)).startswith("root/") and not name.startswith("/")


def members(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of the files in a zip or tar, packed or not, those that would leave its folder left out; a gzip of one file is main.tex; what is damaged, empty or none gives none."""
    if not data:
        return []
    try:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [(n, z.read(n)) for n in z.namelist() if not n.endswith("/") and _inside(n)]
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and _inside(m.name)]
    except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError):
        pass
    try:
        return [("main.tex", gzip.decompress(data))]
    except (OSError, EOFError):
        return []


def archive_texts(archives: DataFrame) -> DataFrame:
    """path, member, text of each file in archives (path, content); one archive is unpacked in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, name, data.decode("utf-8", "replace")) for name, data in members(bytes(content or b""))]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "member", "text"])

    return archives.select("path", "content").mapInPandas(run, "path string, member string, text string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Texts of the archives below a path, a file per task's record so that many are unpacked side by side."""
    return archive_texts(spark.read.format("binaryFile").load(path))


def read_tex(spark: SparkSession, folder: str) -> DataFrame:
    """file, text of all TeX files of a folder and those below it."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.tex").option("recursiveFileLookup", True).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def eprint_text(parts: DataFrame) -> DataFrame:
    """path, text: the TeX members of each archive as one text, the main one (with a document class) first, then by name."""
    main = F.contains("text", F.lit("\\documentclass"))
    ordered = F.array_sort(F.collect_list(F.struct((~main).alias("rest"), "member", "text")))
    return parts.filter(F.lower("member").endswith(".tex")).groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def layered(inline: DataFrame, bbl: DataFrame, bib: DataFrame) -> DataFrame:
    """References (paper_id, cite_key and fields) of three sources: a list's file goes before what stands in the text, BibTeX before both. Of repeated keys in a source the last by ord counts."""
    every = None
    for layer, df in enumerate((inline, bbl, bib)):
        part = df.withColumn("layer", F.lit(layer))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in ("paper_id", "cite_key")]
    best = every.groupBy("paper_id", "cite_key").agg(F.max_by(F.struct(*rest), F.struct("layer", "ord")).alias("r"))
    return best.select("paper_id", "cite_key", *[f"r.{c}" for c in rest if c not in ("layer", "ord")])


def full_text(channels: DataFrame) -> DataFrame:
    """ref_id, text, channel: HTML, else TeX of 500 characters, else PDF, else any TeX; at most 200,000 characters. channels: ref_id, html, tex, pdf."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    whole_tex = F.when(F.length("tex") >= TEX_CHARS, F.col("tex"))
    channel = F.when(some("html").isNotNull(), "arxiv_html").when(whole_tex.isNotNull(), "arxiv_eprint").when(some("pdf").isNotNull(), "arxiv_pdf").when(some("tex").isNotNull(), "arxiv_eprint")
    text = F.coalesce(some("html"), whole_tex, some("pdf"), some("tex"), F.lit(""))
    return channels.select("ref_id", F.substring(text, 1, TEXT_CHARS).alias("text"), channel.alias("channel"))


def open_pdfs(found: DataFrame) -> DataFrame:
    """Links to open PDFs (ref_id, channel, ord, url), the first of equal ones by channel (OpenAlex, Unpaywall, landing page), numbered best first."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(F.lit("openalex_oa"), F.lit("unpaywall"), F.lit("meta_pdf")), F.col("channel"))
    first = found.filter(F.length("url") > 0).groupBy("ref_id", "url").agg(F.min(F.struct(rank.alias("rank"), "ord", "channel")).alias("f")).select("ref_id", "url", "f.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("ref_id").orderBy("rank", "ord"))).select("ref_id", "place", "url", "channel")


def first_text(tried: DataFrame) -> DataFrame:
    """ref_id, text, channel, url of the best link (place) that gave a text; references without one are absent."""
    good = tried.filter(F.length("text") > 0)
    return good.groupBy("ref_id").agg(F.min_by(F.struct("text", "channel", "url"), "place").alias("t")).select("ref_id", "t.*")


def search_links(html: Column, most: int) -> Column:
    """Links of a result page: those of its result anchors, else any that it wraps; unwrapped, http only, not its own, each once, the first most."""
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'<a\b[^>]*class="[^"]*result__a[^"]*"[^>]*>'), F.lit(0))
    direct = F.transform(anchors, lambda a: F.regexp_extract(a, 'href="([^"]+)"', 1))
    wrapped = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("uddg=([^\"'&]+)"), F.lit(1)), lambda u: F.concat(F.lit("uddg="), u))

    def unwrapped(u: Column) -> Column:
        whole = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
        return F.when(F.contains(whole, F.lit("uddg=")), F.try_url_decode(F.regexp_extract(whole, "uddg=([^\"'&]+)", 1))).otherwise(whole)

    links = F.filter(F.transform(F.concat(direct, wrapped), unwrapped), lambda u: u.startswith("http") & ~F.contains(u, F.lit("duckduckgo.com")))
    return F.slice(F.array_distinct(links), 1, most)


def harvest_id(arxiv: Column, url: Column, title: Column, seed: Column) -> Column:
    """A seed's paper: its preprint, else a short hash of its link, its title or all of it."""
    some = lambda c: F.nullif(c, F.lit(""))
    basis = F.coalesce(some(url), some(title), seed)
    return F.coalesce(some(arxiv), F.concat(F.lit("h"), F.substring(F.sha1(basis.cast("binary")), 1, 12)))


def pending(seeds: DataFrame, done: DataFrame) -> DataFrame:
    """Seeds whose paper is not there yet, one of each paper (by ord): a run that was broken off goes on where it stopped."""
    rest = [c for c in seeds.columns if c != "paper_id"]
    first = seeds.groupBy("paper_id").agg(F.min_by(F.struct(*rest), "ord").alias("s")).select("paper_id", *[f"s.{c}" for c in rest])
    return first.join(done.select("paper_id").distinct(), "paper_id", "left_anti")
