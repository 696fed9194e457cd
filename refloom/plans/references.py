"""References, titles, names and TeX: inputs of known fields are spelt out from the tables, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import idents, names, similarity, tex, text, titles
from refloom.operators import grid
from refloom.plans.registry import query, table
from refloom.sources import references

#: (a reference with {t} for its title and {y} for its year, its authors, DOI, preprint, URL): bibliography styles.
_STYLES = (
    ("Huang, G., Van Der Maaten, L., Weinberger, K.Q.: {t}. In: CVPR. pp. 4700-4708 ({y})", "Huang, G.|Van Der Maaten, L.|Weinberger, K.Q.", None, None, None),
    ("Coquand, T. and Huet, G. P. {t}. Information and Computation, {y}.", "Coquand, T.|Huet, G. P.", None, None, None),
    ("Y. You, W.-L. Liu, and C. Lu. {t}. In Conference on Robots, {y}. doi 10.1000/AB.{y}.", "Y. You|W.-L. Liu|C. Lu", "10.1000/AB.{y}", None, None),
    ("David Silver, Karen Simonyan, et al. {t}. nature, 550(7676):354–359, {y}", "David Silver|Karen Simonyan", None, None, None),
    ("Yves Scherrer, Jörg Tiedemann, and Sharid Loáiciga. {y}. {t}. arXiv:1911.03688", "Yves Scherrer|Jörg Tiedemann|Sharid Loáiciga", None, "1911.03688", None),
    ("Harrison Chase. {t}, {y}. URL https://x. org/a- 1 .", "Harrison Chase", None, None, "https://x.org/a-1"),
    ("Ferrucci DA, Lally A et al. {t}. In: AI Magazine. {y}", "Ferrucci DA|Lally A", None, None, None),
    ("OpenAI. {y}. {t}. Blog", "OpenAI", None, None, None),
    ("Cai, H.; Zhang, P.; and Yuan, T. {y}a. {t}. Software Testing, 33(5). arxiv.org/pdf/2102.00182v2", "Cai, H.|Zhang, P.|Yuan, T.", None, "2102.00182v2", None),
    ("M. Jadeja and N. Varia, {t}. {y}", "M. Jadeja|N. Varia", None, None, None),
)


def _lit(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows: tuple, columns: str) -> str:
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(_lit, r))})" for i, r in enumerate(rows)) + f") v(i, {columns})"


def _pick(rows: tuple, column: int, number) -> F.Column:
    return F.get(F.array(*[F.lit(r[column]).cast("string") for r in rows]), F.pmod(number, F.lit(len(rows))).cast("int"))


_TITLE = "'Studies of ' || p_name || ' systems'"


def _entries(spark, sf_dir):
    n = F.col("p_partkey")
    title, year = F.concat(F.lit("Studies of "), "p_name", F.lit(" systems")), (F.lit(1990) + F.col("p_size")).cast("string")
    whole = F.replace(F.replace(_pick(_STYLES, 0, n), F.lit("{t}"), title), F.lit("{y}"), year)
    return table(spark, sf_dir, "part").select(n, F.col("p_size"), whole.alias("entry"), title.alias("title"))


_EXPECTED = f"SELECT p_partkey, {_TITLE} AS title, 1990 + p_size AS year, authors, replace(doi, '{{y}}', CAST(1990 + p_size AS VARCHAR)) AS doi, arxiv, url FROM part JOIN {_values(_STYLES, 'entry, authors, doi, arxiv, url')} ON p_partkey % {len(_STYLES)} = i"


@query(f"SELECT p_partkey, title, CAST(year AS INT) AS year, authors, doi, arxiv, url FROM ({_EXPECTED})")
def reference_entries(spark, sf_dir):
    """Authors, title, year and identifiers of references in ten bibliography styles."""
    x = _entries(spark, sf_dir).withColumn("f", references.entry_fields("entry"))
    return x.select("p_partkey", "f.title", "f.year", F.array_join("f.authors", "|").alias("authors"), "f.doi", "f.arxiv", "f.url")


@query(f"""SELECT p_partkey // 20 AS paper_id, count(*) AS n, CAST(count(DISTINCT authors) AS BIGINT) AS styles, min(title) AS first_title FROM ({_EXPECTED}) GROUP BY 1""")
def reference_lists(spark, sf_dir):
    """Texts with numbered reference lists, cut into entries and parsed."""
    rows = _entries(spark, sf_dir).withColumns({"paper_id": F.floor(F.col("p_partkey") / 20), "no": F.col("p_partkey") % 20 + 1})
    lines = F.transform(F.array_sort(F.collect_list(F.struct("no", "entry"))), lambda x: F.concat(F.lit("["), x["no"], F.lit("] "), F.replace(x["entry"], F.lit(" "), F.lit("\n"))))
    texts = rows.groupBy("paper_id").agg(F.concat(F.lit("Body [1] text.\nReferences\n none yet\n\nREFERENCES\n"), F.array_join(lines, "\n"), F.lit("\nPublisher's Note Springer Nature remains neutral")).alias("text"))
    got = references.reference_table(texts)
    return got.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_distinct("authors").alias("styles"), F.min("title").alias("first_title"))


@query(f"""SELECT p_partkey // 20 AS paper_id, CAST(count(*) AS INT) AS complete, CAST(count(*) AS INT) AS entries, CAST(count(doi) + count(arxiv) + count(url) AS INT) AS identified, 0 AS glue, CAST(sum(length(title)) AS INT) AS title_chars FROM ({_EXPECTED}) GROUP BY 1""")
def reference_scores(spark, sf_dir):
    """How well the reference lists of texts parse."""
    rows = _entries(spark, sf_dir).withColumns({"paper_id": F.floor(F.col("p_partkey") / 20)})
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "entry"))), lambda x: x["entry"])
    texts = rows.groupBy("paper_id").agg(F.concat(F.lit("Body.\nBibliography\n"), F.array_join(lines, "\n\n")).alias("text"))
    return texts.select("paper_id", references.reference_score("text").alias("s")).select("paper_id", "s.*")


#: (key, claim, which entry of _BOOKS it means, -1 for none): keys by surname and year, suffix, keyword, title, acronym, and by what the sentence shows.
_BOOKS = (("Philipp Brauner", "What does the public think", 2023), ("Cai, H.", "Adversarial cases", 2024), ("Cai, H.", "Mobile agents", 2024), ("Cai, H.", "Older ideas", 2020), ("Jakub Konrád", "Alquist 4.0", 2021), ("Ivo Petrov", "Brokenmath: A benchmark", 2025), ("Liang, G.", "LG-VQ: language guided", 2024), ("Thierry Coquand", "Calculus of constructions", 1988), ("Lin, Z.", "Protein folding", 2022))
_KEYS = (
    ("Brauner2023WhatDT", "", "0"), ("cai2024a", "", "1"), ("cai2024b", "", "2"), ("cai-etal-2024-mobile", "", "-1"), ("cai2024mobile", "", "2"), ("cai2019old", "", "3"), ("cai2024", "", "-1"), ("konrad2021alquist", "", "4"), ("brokenmath2025", "", "5"),
    ("guotao2024lg", "as Liang et al. (2024) show", "6"), ("DBLP:x/CoquandH88", "", "7"), ("lin2004rouge", "", "-1"), ("unknown1999", "nothing (Doe, 1999)", "-1"), ("2024cocon", "", "-1"), ("coc1988", "", "7"),
)


@query(f"SELECT p_partkey, CAST(nullif(means, '-1') AS INT) AS ref_ord FROM part JOIN {_values(_KEYS, 'bibkey, claim, means')} ON p_partkey % {len(_KEYS)} = i")
def key_binding(spark, sf_dir):
    """Which entry of its paper's list a citation key means."""
    n = F.col("p_partkey")
    sites = table(spark, sf_dir, "part").select(n, F.floor(n / 500).alias("paper_id"), _pick(_KEYS, 0, n).alias("cite_key"), _pick(_KEYS, 1, n).alias("claim"))
    books = spark.createDataFrame([(i, [a], t, y) for i, (a, t, y) in enumerate(_BOOKS)], "ord int, authors array<string>, title string, year int")
    lists = sites.select("paper_id").distinct().crossJoin(F.broadcast(books))
    return references.bind_sites(sites, lists).select("p_partkey", "ref_ord")


#: (a reference with {t} for its title, whether the title is found; what is found instead).
_TITLED = (
    ('Song Y, Ermon S. "{t}". NeurIPS. 2019', None), ("Sutskever I, Vinyals O, Le Q. {t}. Advances in Neural Information Processing Systems. 2014", None), ("Colby KM, Hilf FD. {t}. J Artif. 1971", None),
    ("Shahriar Golchin and Mihai Surdeanu. {t}. In ICLR, 2024", None), ("Lightman H. “{t}” 2023", None), ("Doe J. 2020. arXiv:2101.00001 {t}", ""), ("In: Proceedings of the {t}. 2020", ""), ("Brown T, Mann B. In: ICML. {t} -- site.org", "{t} -- site.org"),
    ("‘{t}’ by someone", None), ("", ""),
)


@query(f"""SELECT p_partkey, CASE WHEN other IS NULL THEN {_TITLE} ELSE replace(other, '{{t}}', {_TITLE}) END AS title, CASE WHEN other = '' THEN 0 WHEN other IS NULL THEN 1 ELSE 2 END AS variants FROM part JOIN {_values(_TITLED, 'ref, other')} ON p_partkey % {len(_TITLED)} = i""")
def likely_titles(spark, sf_dir):
    """The title in a reference, and how many forms of it are asked for."""
    n = F.col("p_partkey")
    ref = F.replace(_pick(_TITLED, 0, n), F.lit("{t}"), F.concat(F.lit("Studies of "), "p_name", F.lit(" systems")))
    return table(spark, sf_dir, "part").select(n, titles.likely_title(ref).alias("title"), F.size(titles.title_variants(ref)).alias("variants"))


@query(f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Key, D. "Toward ' || p_name || ' synthesis" 2022' ELSE '' END AS subtitle, CASE p_partkey % 3 WHEN 1 THEN false WHEN 2 THEN true ELSE true END AS contradicts,
  CASE p_partkey % 3 WHEN 0 THEN 'key' WHEN 1 THEN 'vaswani' ELSE '' END AS leading, CASE p_partkey % 3 WHEN 0 THEN 'Key' WHEN 1 THEN 'Vaswani' ELSE '' END AS searched FROM part""")
def reference_heads(spark, sf_dir):
    """Subtitle, contradiction of titles, and first authors of references."""
    n, name = F.col("p_partkey"), F.col("p_name")
    ref = (
        F.when(n % 3 == 0, F.concat(F.lit('Key, D. "I Speak, You Verify: Toward '), name, F.lit(' synthesis" 2022')))
        .when(n % 3 == 1, F.concat(F.lit('Vaswani A, et al. "A plain title on '), name, F.lit(' attention" 2020')))
        .otherwise(F.concat(F.lit('3 4. "Model 12 of '), name, F.lit('" 2020')))
    )
    other = F.when(n % 3 == 0, F.lit("Cooking rice well")).when(n % 3 == 1, F.concat(F.lit("A Plain Title on "), name, F.lit(" Attention: revisited"))).otherwise(F.concat(F.lit("Model 13 of "), name))
    return table(spark, sf_dir, "part").select(n, titles.subtitle_reference(ref).alias("subtitle"), titles.reference_contradicts(ref, other).alias("contradicts"), names.first_token_surname(ref).alias("leading"), names.search_surname(ref).alias("searched"))


@query("""SELECT p_partkey, trim(CASE WHEN p_partkey % 3 <> 0 THEN 'A, B "' || p_name || '" ' || p_type || CASE WHEN p_size > 10 THEN ' ' || (1990 + p_size) ELSE '' END ELSE CASE WHEN p_partkey % 2 = 0 THEN 'raw arXiv text' ELSE 'A, B' || CASE WHEN p_size > 10 THEN ' ' || (1990 + p_size) ELSE '' END || ' ' || p_type END END
  || CASE WHEN p_partkey % 5 = 0 AND NOT (p_partkey % 3 = 0 AND p_partkey % 2 = 0) THEN ' arXiv:2101.1' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' doi:10.1/X' ELSE '' END) AS reference FROM part""")
def reference_strings(spark, sf_dir):
    """The text that a reference is looked up by."""
    n = F.col("p_partkey")
    year = F.when(F.col("p_size") > 10, F.lit(1990) + F.col("p_size")).otherwise(0).cast("int")
    whole = titles.reference_string(F.when(n % 3 != 0, F.col("p_name")), F.array(F.lit("A"), F.lit(""), F.lit("B")), year, F.col("p_type"), F.when(n % 2 == 0, " raw arXiv text "), F.when(n % 5 == 0, "2101.1"), F.when(n % 7 == 0, "10.1/X").otherwise(""))
    return table(spark, sf_dir, "part").select(n, whole.alias("reference"))


@query("""SELECT p_partkey, p_partkey % 6 NOT IN (4, 5) AS same FROM part""")
def strings_alike(spark, sf_dir):
    """Whether two titles say the same: held in one another, with spaces lost, with words in another order, empty, or not at all."""
    n, a = F.col("p_partkey") % 6, F.concat(F.lit("Scale-Invariant "), "p_name", F.lit(" keypoints for matching"))
    b = (
        F.when(n == 0, F.upper(a)).when(n == 1, F.concat(F.lit("scaleinvariant "), "p_name", F.lit(" keypoints for matching"))).when(n == 2, F.concat(F.lit("keypoints for matching: "), "p_name", F.lit(" scale invariant")))
        .when(n == 3, "?!").when(n == 4, "Deep residual learning for image recognition").otherwise("quite other words")
    )
    return table(spark, sf_dir, "part").select("p_partkey", similarity.strings_match(a, b).alias("same"))


#: (cited, canonical, whether one person, surname and initial of the cited name).
_PEOPLE = (
    ("Firat M", "Mehmet Fırat", "n", "firat", "m"), ("Yang Z", "Zhengyuan Yang", "y", "yang", "z"), ("Adewumi T", "Tosin P. Adewumi", "y", "adewumi", "t"), ("Chen C-FR", "Chun-Fu Chen", "y", "chen", "c"), ("YangZ", "Zhengyuan Yang", "y", "yang", "z"),
    ("V aswani A", "Ashish Vaswani", "y", "vaswani", "a"), ("Yang, Zhengyuan", "Zhengyuan Yang", "y", "yang", "z"), ("Müller H", "Hans Muller", "y", "muller", "h"), ("Smith J", "Jones A", "n", "smith", "j"), ("Yang Z", "Yang Q", "n", "yang", "z"),
    ("S. R.", "Ethan Perez", "n", "", "s"), ("", "A B", "n", "", ""),
)


@query(f"SELECT c_custkey, same = 'y' AS same, surname, initial FROM customer JOIN {_values(_PEOPLE, 'a, b, same, surname, initial')} ON c_custkey % {len(_PEOPLE)} = i")
def same_people(spark, sf_dir):
    """Names in all their forms."""
    n = F.col("c_custkey")
    a, b = _pick(_PEOPLE, 0, n), _pick(_PEOPLE, 1, n)
    rows = table(spark, sf_dir, "customer").select(n, names.same_author(a, b).alias("same"), names.name_key(a).alias("k"))
    return rows.select("c_custkey", "same", "k.surname", "k.initial")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'first-author mismatch: cited ''Huang J'' vs ''Tom B. Brown''' WHEN 2 THEN 'author list differs substantially from the canonical record' END AS issue FROM customer""")
def author_issues(spark, sf_dir):
    """What is wrong with cited author lists: organisations and hyphens excuse."""
    n = F.col("c_custkey") % 6
    a = F.when(n == 0, F.array(F.lit("Diego Perez-Liebana"))).when(n == 1, F.array(F.lit("Huang J"))).when(n == 2, F.array(F.lit("Brown T"), F.lit("Lee K"), F.lit("Poe E"))).when(n == 3, F.array(F.lit("An Yang"))).when(n == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("Brown T"), F.lit("Lee K")))
    b = F.when(n == 0, F.array(F.lit("Diego Perez Liebana"))).when(n == 3, F.array(F.lit("Qwen Team"))).otherwise(F.array(F.lit("Tom B. Brown"), F.lit("K. Lee")))
    return table(spark, sf_dir, "customer").select("c_custkey", names.author_issue(a, F.when(n == 2, F.array(F.lit("Tom Brown"))).otherwise(b)).alias("issue"))


@query(r"""SELECT p_partkey, 'Rothörl & Ångström wrote ' || p_name || ' with Łukasz in naïve groß terms 5' AS prose, '84.21% ' || p_name || ' (b)' AS cell FROM part""")
def tex_text(spark, sf_dir):
    """TeX to plain text: prose, and a table cell."""
    prose = F.concat(F.lit(r"\section{Gone} Roth\"orl \& \AA{}ngstr\"{o}m~wrote \emph{"), "p_name", F.lit(r"} \citep[see][p.~3]{a,b}with {\L}ukasz in na\"{i}ve gro\ss{} \alpha terms 5 ."))
    cell = F.concat(F.lit(r"\textbf{\emph{84.21\%}} \cellcolor[gray]{0.9}"), "p_name", F.lit(" $(b)$ \\cite{x} % gone\n"))
    return table(spark, sf_dir, "part").select("p_partkey", tex.strip_tex(prose).alias("prose"), tex.strip_cell(cell).alias("cell"))


@query("""SELECT p_partkey, 'k' || p_partkey || ',b,c' AS keys, p_size % 3 <> 0 AS dense, p_size IN (404, 410) OR p_partkey % 4 = 1 AS dead FROM part""")
def marker_keys(spark, sf_dir):
    """Citation keys in TeX, density of a list's numbers, and dead links."""
    n = F.col("p_partkey")
    cell = F.concat(F.lit(r"x \citep[see][]{k"), n, F.lit(r", b} and \autocite*{c}\citation{no}"))
    numbers = F.when(F.col("p_size") % 3 != 0, F.sequence(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(427)))
    status = F.when(n % 4 == 1, 410).when(n % 4 == 2, 500).when(n % 4 == 3, 403)
    return table(spark, sf_dir, "part").select(n, F.array_join(idents.cite_keys(cell), ",").alias("keys"), idents.dense_numbering(numbers).alias("dense"), idents.url_dead(status).alias("dead"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'the ' || p_name || ' is kept' WHEN 1 THEN 'all tasks of ' || p_name ELSE p_name || ' holds' END AS property,
  CASE WHEN p_partkey % 2 = 0 THEN 'It must hold under occlusion of ' || p_name || '.' ELSE 'We use ' || p_name || '.' END AS gloss,
  CASE p_partkey % 3 WHEN 0 THEN 'task awareness;task-awareness;taskawareness;task aware;task-aware;taskaware' WHEN 1 THEN 'adaption;adaptive' ELSE '' END AS v FROM part""")
def column_definitions(spark, sf_dir):
    """Definitions of columns without references to floats and without the authors' own choices, and spellings of headers."""
    n, name = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(n % 3 == 0, F.concat(F.lit("the "), name, F.lit(" is kept (tasks C and D in Figure~\\ref{fig:a}b), as reported in Table 3.")))
        .when(n % 3 == 1, F.concat(F.lit("all  tasks of "), name, F.lit(" \\cite{x} see Section 4")))
        .otherwise(F.concat(name, F.lit(" holds ( );")))
    )
    gloss = F.when(n % 2 == 0, F.concat(F.lit("It must hold under occlusion of "), name, F.lit(". Thus, we prefer raw inputs. Hence our method adopts it."))).otherwise(F.concat(F.lit("We use "), name, F.lit(".")))
    gloss = F.regexp_replace(gloss, " Hence our method adopts it\\.", " Our work use it.")
    header = F.when(n % 3 == 0, "Task-aware").when(n % 3 == 1, " Adaptive").otherwise("!")
    return table(spark, sf_dir, "part").select(n, grid.clean_property(raw).alias("property"), grid.drop_rationale(gloss).alias("gloss"), F.array_join(grid.header_variants(header), ";").alias("v"))


@query("""SELECT p_partkey, 'A. Bee and C Dee. ' || p_name || '. 2001. J' AS raw, 'A. Bee|C Dee' AS authors, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'J' ELSE 'P' END AS venue, CASE WHEN p_partkey % 3 = 0 THEN '2101.1' END AS arxiv,
  'A. Bee, C Dee. "' || p_name || '"' || CASE WHEN p_partkey % 2 = 0 THEN '. J' ELSE '' END || '. 2001' AS line FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 'A. Bee and C Dee. ' || p_name || '. 2001', 'A. Bee|C Dee', p_name, 'P', CASE WHEN p_partkey % 3 = 0 THEN '2101.1' END, 'A. Bee, C Dee. "' || p_name || '". 2001' FROM part WHERE p_partkey % 2 = 1""")
def bib_cited_as(spark, sf_dir):
    """BibTeX fields as citations, and as a line."""
    n = F.col("p_partkey")
    entry = F.map_filter(
        F.create_map(
            F.lit("author"), F.lit("A. Bee and C Dee"), F.lit("title"), F.concat(F.lit("{"), "p_name", F.lit("}")), F.lit("year"), F.lit("2001"), F.lit("journal"), F.when(n % 2 == 0, "J"), F.lit("publisher"), F.lit("P"),
            F.lit("eprint"), F.lit("2101.1"), F.lit("archiveprefix"), F.when(n % 3 == 0, "arXiv").otherwise("other"),
        ),
        lambda k, v: v.isNotNull(),
    )
    c = references.cited_as(entry)
    return table(spark, sf_dir, "part").select(n, c["raw"].alias("raw"), F.array_join(c["authors"], "|").alias("authors"), c["title"].alias("title"), c["venue"].alias("venue"), c["arxiv"].alias("arxiv"), references.bib_raw(entry).alias("line"))


@query("""SELECT s_suppkey, 'eric muller - coffi 10' AS folded, substr('a b ' || repeat('x', 600), 1, 600) AS gold, CASE WHEN s_suppkey % 2 = 0 THEN repeat('y', 59) || '…' ELSE repeat('y', 60) END AS short FROM supplier""")
def text_forms(spark, sf_dir):
    """Folding, the gold side's markup, and short forms."""
    n = F.col("s_suppkey")
    gold = text.gold_markup(F.concat(F.lit("<p>a <b>b</b> "), F.repeat(F.lit("x"), 700)))
    return table(spark, sf_dir, "supplier").select(n, text.fold(F.lit("Éric Müller - Coﬃ １０")).alias("folded"), gold.alias("gold"), text.short(F.repeat(F.lit("y"), F.when(n % 2 == 0, 61).otherwise(60))).alias("short"))
