import random

import pytest
from pyspark.sql import functions as F

from refloom.functions import idents, names, similarity, tex, text, titles
from refloom.operators import grid
from refloom.operators.severity import derive_severity
from refloom.sources import references


def value(spark, column, *args):
    schema = ", ".join(f"c{i} {'array<string>' if isinstance(a, list) else 'int' if isinstance(a, int) else 'string'}" for i, a in enumerate(args))
    return spark.createDataFrame([args], schema).select(column(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize(
    "exists, supports, priority, want",
    [
        ("no", "supports", "helpful", "high"), ("yes", "does_not", "obligatory", "high"), ("yes", "partial", "obligatory", "medium"), ("yes", "does_not", "helpful", "low"), ("unresolved", "supports", "obligatory", "low"),
        ("yes", "inconclusive", "obligatory", "low"), ("yes", "partial", "helpful", "low"), ("yes", "supports", "obligatory", "ok"), ("yes", "skipped", "helpful", "ok"),
    ],
)
def test_severity_table(spark, exists, supports, priority, want):
    assert value(spark, derive_severity, exists, supports, priority) == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_similarity_ratios():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 90))) for _ in range(2))
        assert similarity._lcs(a, b) == lcs(a, b)
    assert similarity.token_sort_ratio("b a", "a b") == 100
    assert similarity.token_set_ratio("deep learning", "deep learning for proteins") == 100
    assert similarity.token_set_ratio("", "x") == 0
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)


def test_text_rules(spark):
    assert value(spark, text.norm_title, "  Loáiciga: A\tStudy!") == "loáiciga a study"
    assert value(spark, text.norm_title_ascii, "Loáiciga-X") == "lo iciga x"
    assert value(spark, text.normalize_url, "http: //a.org/x y, 2019a.") == "http://a.org/xy"
    assert value(spark, text.despace_line, "D e e p l e a r n") == "Deeplearn"
    assert value(spark, text.despace_line, "a normal line of text here") == "a normal line of text here"
    assert value(spark, text.cell_escape, " a|b\nc ") == "a\\|b c"
    assert value(spark, text.strip_comments, "a 5\\% b % gone\nc") == "a 5\\% b \nc"
    assert value(spark, text.slice_intro, "Abstract x Introduction we do this. Related Work others") == "we do this."


def test_identifier_rules(spark):
    assert value(spark, idents.doi, "see 10.1000/AbC.1. Next") == "10.1000/abc.1"
    assert value(spark, idents.doi, "see (10.1000/xyz123)") == "10.1000/xyz123"
    assert value(spark, idents.arxiv_id, "arXiv: 2101.00001v3") == "2101.00001v3"
    assert value(spark, idents.arxiv_id, "arXiv:math.GT/0309136") == "math.gt/0309136"
    assert value(spark, idents.arxiv_id, "2101.00001") is None
    assert value(spark, idents.year_max, "1999 and 2003 and 1850") == 2003
    assert value(spark, idents.year_last, "2003 then 1999x") == 1999
    assert value(spark, idents.year_prefix, "19ab") is None
    assert value(spark, idents.expand_marker, "3, 5-7, 1-99, x") == ["ref-3", "ref-5", "ref-6", "ref-7"]
    assert [value(spark, idents.http_class, s) for s in (200, 403, 404)] == ["live", "blocked", "dead"]
    assert value(spark, idents.source_kind, "2101.00001v2") == "arxiv" and value(spark, idents.source_kind, "a/b.tar.gz") == "archive"


def test_names(spark):
    assert value(spark, names.last_name, "Curie, Marie") == "curie" and value(spark, names.last_name, "Marie Curie") == "curie"
    assert tuple(value(spark, names.name_key, "Curie MS")) == ("curie", "m")
    assert value(spark, names.citation_cell, ["A", "B", "C"], "T", 2020, "", "k") == "A et al., T, 2020"
    assert value(spark, names.citation_cell, ["A", "B"], "", 0, "", "k") == "A, B" and value(spark, names.citation_cell, [], "", 0, " ", "k") == "k"
    assert value(spark, names.author_issue, ["Marie Curie"], ["Curie M"]) is None
    assert value(spark, names.author_issue, ["Niels Bohr"], ["Curie M"]) == "first-author mismatch: cited 'Niels Bohr' vs 'Curie M'"


#: (cited, canonical, one person): abbreviated, glued, torn, hyphenated and folded forms, and real differences.
PEOPLE = [
    ("Firat M", "Mehmet Firat", True), ("Yang Z", "Zhengyuan Yang", True), ("Adewumi T", "Tosin P. Adewumi", True), ("Ferrucci DA", "David A Ferrucci", True), ("Chen C-FR", "Chun-Fu Chen", True), ("YangZ", "Zhengyuan Yang", True),
    ("V aswani A", "Ashish Vaswani", True), ("Y uan H", "Hongping Yuan", True), ("Yang, Zhengyuan", "Zhengyuan Yang", True), ("M\u00fcller H", "Hans Muller", True), ("Smith J", "Jones A", False), ("Yang Z", "Yang Q", False), ("", "A B", False), (None, None, False),
]


@pytest.mark.parametrize(("cited", "canonical", "same"), PEOPLE)
def test_people(cited, canonical, same):
    assert names.one_person(cited, canonical) == same


def test_author_lists():
    assert names.key_of("S. R.") == ("", "s") and names.key_of("S.") == ("s.", "")
    for cited, canonical in ((["Tom Brown", "Benjamin Mann"], ["OpenAI"]), (["DeepSeek-AI"], ["Daya Guo"]), (["An Yang", "Baosong Yang"], ["Qwen Team"]), (["Gemini Team"], ["Rohan Anil"]), (["Qingwen Bu"], ["AgiBot-World-Contributors"]), (["Diego Perez-Liebana"], ["Diego Perez Liebana"])):
        assert names.issue_of(cited, canonical) is None
    for cited, canonical in ((["Huang J"], ["Tom B. Brown"]), (["Smith J", "Jones A"], ["Adams B", "Clark C"]), (["George Kingsley Zipf"], ["Y. Chao"]), (["Abby O'Neill"], ["A. Padalkar"])):
        assert names.issue_of(cited, canonical)


@pytest.mark.parametrize("raw, mark", [("✓", "yes"), ("✗", "no"), ("—", "no"), ("", "empty"), ("N/A", "empty"), ("Partially", "partial"), ("high", "yes"), ("none", "no"), ("83.1", "value"), ("✓✗", "value"), ("◐", "partial"),
    (r"\cmark", "yes"), (r"\xmark", "no"), (r"\ding{51}", "yes"), (r"\ding{55}", "no"), (r"$\checkmark$", "yes"), ("n.a.", "empty"), ("unk", "empty"), ("No-Reference", "value"), ("Full fine-tuning", "value"), ("gradient-based", "value"), (r"\textbf{Yes}~\cite{x}", "yes")])
def test_marks(spark, raw, mark):
    assert value(spark, grid.normalize_mark, raw) == mark


def test_contradiction(spark):
    def contradicts(a, b):
        return value(spark, lambda x, y: similarity.title_contradiction(similarity.title_tokens(x), similarity.title_tokens(y)), a, b)

    assert contradicts("Llama 12 models", "Llama 13 models") and not contradicts("Llama 2 models", "Llama 3 models") and not contradicts("A study of cats", "Study of the cats and dogs")
    assert contradicts("vision transformers", "vision networks") and not contradicts("", "x")


@pytest.mark.parametrize(
    ("reference", "title"),
    [
        ('Song Y, Ermon S. "Generative modeling by estimating gradients of the data distribution". NeurIPS 2019', "Generative modeling by estimating gradients of the data distribution"), ("Sutskever I, Vinyals O, Le Q. Sequence to sequence learning. NIPS. 2014", "Sequence to sequence learning"),
        ("Shahriar Golchin and Mihai Surdeanu. Time travel in language models. 2023", "Time travel in language models"), ("Brown T, Mann B. In: Advances in neural information processing systems. 2020. Language models are few-shot learners", "Language models are few-shot learners"),
        ("", ""), ("Smith, J. 2020.", ""), ("Lightman H. \u201cLet\u2019s verify step by step\u201d", "Let\u2019s verify step by step"),
    ],
)
def test_likely_title(spark, reference, title):
    assert value(spark, titles.likely_title, reference) == title


def test_title_variants_and_subtitle(spark):
    assert value(spark, titles.title_variants, 'A B. "A study of things -- site.org" 2020') == ["A study of things -- site.org", "A study of things"]
    assert value(spark, titles.subtitle_reference, 'Key, D. "I Speak, You Verify: Toward trustworthy neural program synthesis" 2022') == 'Key, D. "Toward trustworthy neural program synthesis" 2022'
    assert value(spark, titles.subtitle_reference, 'Foo B. "A plain title with no colon" 2020') == ""


def test_strings_match(spark):
    assert value(spark, similarity.strings_match, "Distinctive image features from scaleinvariant keypoints", "Distinctive Image Features from Scale-Invariant Keypoints")
    assert not value(spark, similarity.strings_match, "Attention is all you need", "Deep residual learning for image recognition")
    assert value(spark, similarity.strings_match, "", "x") and value(spark, similarity.strings_match, "b a c d", "d c a b")


#: (entry, authors, title).
ENTRIES = [
    ("Radford A, Wu J, Sutskever I. Language models are unsupervised. OpenAI Blog. 2019", ["Radford A", "Wu J", "Sutskever I"], "Language models are unsupervised"),
    ("Kulkarni P, Mahabaleshwarkar A, Gadgil K, Conversational AI: An overview of methodologies. In: ICCUBEA. 2019.", ["Kulkarni P", "Mahabaleshwarkar A", "Gadgil K"], "Conversational AI: An overview of methodologies"),
    ("CarpenterR.Jabberwacky-acasestudy.In:Proceedings", [], None), ("Carpenter R. Evaluation of Cleverbot. In: Proceedings", ["Carpenter R"], "Evaluation of Cleverbot"),
    ("Saharia, C., Gontijo Lopes, R., Karagol Ayan, B., Salimans, T., et al.: Photorealistic text-to-image diffusion models. In: NeurIPS (2022)", ["Saharia, C.", "Gontijo Lopes, R.", "Karagol Ayan, B.", "Salimans, T."], "Photorealistic text-to-image diffusion models"),
    ("Dan Kondratyuk, Lijun Yu, Ming- Hsuan Yang, David A Ross, and Lu Jiang. Videopoet: A large language model. In Proceedings, 2024", ["Dan Kondratyuk", "Lijun Yu", "Ming-Hsuan Yang", "David A Ross", "Lu Jiang"], "Videopoet: A large language model"),
    ("Azerbayev, Z., Schoelkopf, H., Paster, K., et al. Llemma: An open language model for mathematics. In ICLR, 2024.", ["Azerbayev, Z.", "Schoelkopf, H.", "Paster, K."], "Llemma: An open language model for mathematics"),
    ("Key, D., Li, W.-D., and Ellis, K. I Speak, You Verify: Toward trustworthy neural program synthesis. 2024.", ["Key, D.", "Li, W.-D.", "Ellis, K."], "I Speak, You Verify: Toward trustworthy neural program synthesis"),
    ("Chen, Y.; Li, B.; and Ren, K. 2025a. Taught well learned ill: Towards distillation-conditional backdoor attack. In NeurIPS.", ["Chen, Y.", "Li, B.", "Ren, K."], "Taught well learned ill: Towards distillation-conditional backdoor attack"),
    ("Marthe Ballon, Andres Algaba, and Vincent Ginis. 2025. The relationship between reasoning and performance. arXiv:2502.01234.", ["Marthe Ballon", "Andres Algaba", "Vincent Ginis"], "The relationship between reasoning and performance"),
    ("Liang Chen, Yifan Song, and Vinci. R1-v: Reinforcing super generalization. https://x", ["Liang Chen", "Yifan Song", "Vinci"], "R1-v: Reinforcing super generalization"),
    ("Philippe Laban, Lidiya Murakhovs\u2019 ka, and Chien-Sheng Wu. Are you sure? challenging llms. arXiv preprint, 2023.", ["Philippe Laban", "Lidiya Murakhovs\u2019ka", "Chien-Sheng Wu"], "Are you sure? challenging llms"),
]


@pytest.mark.parametrize(("entry", "authors", "title"), ENTRIES)
def test_reference_entries(entry, authors, title):
    got = references.parse_entry(references.clean_entry(entry))
    assert (got["authors"], got["title"]) == (authors, title)


def test_reference_lists_and_cleaning():
    clean = references.clean_entry
    assert clean("x arXiv:2503.18892,2025.6").endswith("2025") and clean("go. nature, 550(7676):354\u2013359,2017.2,17").endswith("2017") and clean("scale- invariant") == "scale- invariant"
    assert references.trim_title("A study of GPT 2 behaviour") == "A study of GPT 2 behaviour" and references.trim_title("Diffusion models: a survey, 2025") == "Diffusion models: a survey"
    body, block = references.body_and_references("Text\nReferences\nno\nReferences\n\nSmith, J. One thing. 2001. acl-long.\n427. URL x\n\nLee, K. Other things. 2002")
    assert body.startswith("Text\nReferences") and [k for k, _ in references.entries(block)] == ["ref-1", "ref-2"]
    assert references.entries("[1] A B.\n[2] C D.\n[3] E F. Publisher's Note nothing") == [("ref-1", "A B."), ("ref-2", "C D."), ("ref-3", "E F.")]
    assert references.entries(" ") == [] and references.parse_score("no list") == (0, 0, 0, 0, 0)
    assert references.key_surnames("Martin-Lof, P.") == ["martinlof", "martin"] and references.key_surnames("Yang Z") == ["yang"] and references.key_surnames(None) == []
    assert tex.decode_accents(r"Roth\"orl, \'{e}, \ss{}, \v{s}, 5\%") == "Roth\u00f6rl, \u00e9, \u00df, \u0161, 5\\%"


def test_empty_tables_give_none(spark):
    texts = spark.createDataFrame([], "paper_id string, text string")
    assert references.reference_table(texts).count() == 0
    assert references.reference_table(spark.createDataFrame([("p", None), ("q", "")], "paper_id string, text string")).count() == 0
