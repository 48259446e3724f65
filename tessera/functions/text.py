"""Scalar functions on links, identifiers, names, titles, prompts and page text; all run inside the JVM.

A null argument gives null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Display names of models (fixed values).
DISPLAY_NAMES = {
    "google_gemini-2.5-pro-preview-03-25": "Gemini 2.5 Pro",
    "qwen_qwen-2.5-72b-instruct": "Qwen 2.5 72B",
    "deepseek_deepseek-chat-v3-0324": "DeepSeek V3",
    "meta-llama_llama-4-maverick": "Llama 4 Maverick",
    "openai_gpt-4o": "GPT 4o",
    "anthropic_claude-3.5-sonnet": "Claude 3.5 Sonnet",
    "google_gemma-3-27b-it": "Gemma 3 27B",
}
#: Families matched by a part of the name rather than the whole (fixed values).
DISPLAY_PARTS = ("google_gemma-3-27b-it",)
#: Short names that a provider lists under another name (fixed values).
PROVIDER_ALIASES = {"DeepSeek-V3": "deepseek/deepseek-chat:free", "DeepSeek-R1": "deepseek/deepseek-reasoner:free"}
BROWSING = "-browsing"
#: What counts as white space.
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD_TOKENS, TOKEN_LIMIT, CHARACTER_LIMIT = 1.6, 30_000, 150_000


def _without(c: Column, *parts: str) -> Column:
    return reduce(lambda x, part: F.replace(x, F.lit(part), F.lit("")), parts, c)


def last_part(c: Column, separator: str = "/") -> Column:
    """What follows the last separator."""
    return F.substring_index(c, separator, -1)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def arxiv_link(link: Column) -> Column:
    """The abstract page of a link: ``v1`` to ``v4`` are dropped wherever they stand (so ``v12`` leaves ``2``), ``v5`` stays.

    ``.pdf`` is dropped everywhere if the link ends with it, and stays otherwise.
    """
    bare = _without(link, "v1", "v2", "v3", "v4")
    bare = F.when(bare.endswith(".pdf"), _without(bare, ".pdf")).otherwise(bare)
    return F.concat(F.lit("https://arxiv.org/abs/"), last_part(bare))


def arxiv_id(link: Column) -> Column:
    return last_part(arxiv_link(link))


def identifier_id(identifier: Column) -> Column:
    """The bare id of a link, an ``arxiv:`` name or an id: cut at the first ``v``."""
    path = F.regexp_replace(F.regexp_replace(identifier, r"[?#].*$", ""), r"^https?://[^/]*", "")
    bare = F.when(identifier.startswith("http"), last_part(path)).otherwise(identifier)
    bare = F.when(bare.startswith("arxiv:"), F.substr(bare, F.lit(7))).otherwise(bare)
    return strip(F.substring_index(bare, "v", 1))


def versionless_id(paper_id: Column) -> Column:
    """Without ``v1``, ``v2`` and ``v3``."""
    return _without(paper_id, "v1", "v2", "v3")


def path_part(path: Column, index: int = 2) -> Column:
    """Part ``index`` (from 0) of a path: the paper in ``static/<set>/<paper>/...``; null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(index + 1))


def clean_url(link: Column) -> Column:
    r"""The link inside ``\url{...}``, stripped, with the short host of the hub."""
    inner = F.regexp_replace(link, r"\\url\{(.*?)\}", "$1")
    return F.replace(strip(inner), F.lit("huggingface"), F.lit("hf"))


def repository_link(given: Column, link: Column, hub_link: Column, has_link: bool = True) -> Column:
    """The explicit link, else ``link`` if the record has that field (even empty), else the hub's if there is one."""
    explicit = F.when(F.coalesce(given, F.lit("")) != "", given)
    return F.coalesce(explicit, F.coalesce(link, F.lit("")) if has_link else F.when(F.coalesce(hub_link, F.lit("")) != "", link), F.lit(""))


def repository_kind(link: Column) -> Column:
    """Where a repository's description is read from: ``hub``, ``git`` or ``page``."""
    return F.when(link.contains("hf") | link.contains("huggingface"), "hub").when(link.contains("github"), "git").otherwise("page")


def content_hash(content: Column, length: int = 5) -> Column:
    """The first hexadecimal digits of the SHA-1 of a text or binary column."""
    return F.substring(F.sha1(content), 1, length)


def synthetic_id(content: Column, year: Column, month: Column) -> Column:
    """The id of an uploaded file: year, month without padding, and its hash."""
    return F.concat(year.cast("string"), month.cast("string"), F.lit("."), content_hash(content))


def clean_title(title: Column) -> Column:
    return _without(F.replace(title, F.lit("\r\n"), F.lit(" ")), ":")


def word_count(text: Column) -> Column:
    """Parts between single spaces: 1 for the empty text, and two spaces enclose an empty part."""
    return F.size(F.split(text, " ", -1))


def trim_tokens(text: Column, tokens: int = TOKEN_LIMIT, characters: int = CHARACTER_LIMIT, per_word: float = WORD_TOKENS) -> Column:
    """The first ``characters`` of a text of more than an estimated ``tokens``, else the text."""
    return F.when(word_count(text) * F.lit(per_word) > tokens, F.substring(text, 1, characters)).otherwise(text)


def cut_context(text: Column, part: str = "all") -> Column:
    """All, the first half or the first quarter of a text."""
    shares = {"all": 1, "half": 2, "quarter": 4}
    if part not in shares:
        raise ValueError(f"unknown context size: {part}")
    return text if part == "all" else F.substr(text, F.lit(1), F.floor(F.length(text) / shares[part]).cast("int"))


def base_model(model: Column) -> Column:
    return _without(model, BROWSING)


def display_model(model: Column, names: Mapping[str, str] | None = None, parts: tuple[str, ...] = DISPLAY_PARTS) -> Column:
    """The name shown in reports; a browsing variant says so."""
    names = DISPLAY_NAMES if names is None else names
    base = base_model(model)
    shown = base
    for name, display in reversed(names.items()):
        shown = F.when(base.contains(name) if name in parts else base == name, display).otherwise(shown)
    return F.concat(shown, F.when(model.contains(BROWSING), " Browsing").otherwise(""))


def model_to_path(model: Column, browsing: Column | None = None) -> Column:
    name = F.replace(model, F.lit("/"), F.lit("_"))
    return name if browsing is None else F.concat(name, F.when(browsing, BROWSING).otherwise(""))


def path_to_model(name: Column) -> Column:
    """The inverse as the reports use it: every ``_`` becomes ``/``."""
    return F.replace(_without(name, BROWSING), F.lit("_"), F.lit("/"))


def token_cost(tokens: Column, price: Column) -> Column:
    """Tokens at a price for a million; -1 where the price is not known."""
    return F.coalesce(tokens / F.lit(1e6) * price, F.lit(-1.0))


def bibtex_id(link: Column) -> Column:
    """The id in an ``/abs/`` or ``/pdf/`` link, cut at the first ``v``; null for other links."""
    after = F.when(link.contains("/abs/"), last_part(link, "/abs/")).when(link.contains("/pdf/"), _without(last_part(link, "/pdf/"), ".pdf"))
    return F.substring_index(after, "v", 1)


def bibtex(name: Column, title: Column, authors: Column, year: Column, paper_id: Column, link: Column) -> Column:
    """A BibTeX entry; its key is the name with ``_`` for spaces."""
    key = F.replace(name, F.lit(" "), F.lit("_"))
    form = "@article{%s,\n  title = {%s},\n  author = {%s},\n  year = {%s},\n  archivePrefix = {arXiv},\n  journal={arXiv preprint arXiv: %s},\n  primaryClass = {cs.AI},\n  eprint = {%s},\n  url = {%s}\n}"
    return F.format_string(form, key, title, F.array_join(authors, " and "), year.cast("string"), paper_id, paper_id, link)


def citation(name: Column) -> Column:
    key = F.replace(name, F.lit(" "), F.lit("_"))
    return F.concat(F.replace(key, F.lit("_"), F.lit(" ")), F.lit(" \\cite{"), key, F.lit("}"))


def prompt(schema_text: Column, paper_text: Column, examples: Column | None = None, shots: int = 0) -> Column:
    """The instruction for one paper; with ``shots``, after that many of the ``examples`` (an array of texts)."""
    lead = F.concat(F.lit("Input Schema: "), schema_text, F.lit("\n"))
    if examples is None or not shots:
        return F.concat(lead, F.lit("Paper Text: "), paper_text, F.lit("\nOutput JSON:"))
    shown = F.array_join(F.slice(examples, 1, shots), "\n")
    return F.concat(lead, F.lit("Here are some examples:\n"), shown, F.lit("\nNow, predict for the following paper:\nPaper Text: "), paper_text, F.lit("\nOutput JSON:"))


def update_prompt(metadata_text: Column, readme: Column, schema_text: Column) -> Column:
    """The instruction of the browsing pass: a record to be completed from a repository's description."""
    return F.concat(F.lit("Metadata: "), metadata_text, F.lit("\nReadme: "), readme, F.lit("\nInput Schema: "), schema_text, F.lit("\nOutput JSON:"))


def example_text(text: Column, record: Column) -> Column:
    return F.concat(F.lit("Paper Text: "), text, F.lit("\nOutput JSON: "), record)


def says_yes(answer: Column) -> Column:
    """How the answer of a yes-or-no predicate is read."""
    return F.coalesce(F.lower(answer).contains("yes"), F.lit(False))


def strip_comments(latex: Column) -> Column:
    """LaTeX without its comments: from a ``%`` that is not escaped to the end of the line."""
    return F.regexp_replace(latex, r"(?<!\\)%[^\n]*", "")


def page_text(html: Column) -> Column:
    """``Title: ...``, a blank line, and the text of the paragraphs; scripts and styles are dropped first."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    title = F.regexp_extract(bare, r"(?is)<title[^>]*>(.*?)</title>", 1)
    inner = F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1), lambda p: F.regexp_replace(p, r"<[^>]*>", ""))
    text = F.concat(F.lit("Title: "), F.when(title == "", "Untitled Page").otherwise(title), F.lit("\n\n"), F.array_join(inner, " "))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def date_query(year: Column, month: Column) -> Column:
    """The clause for a year, or a month of it: from its first day to the first day after it; empty without a year.

    A month outside 1 to 12 is an error.
    """
    start = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
    end = F.add_months(start, F.when(month.isNull(), 12).otherwise(1))
    day = lambda d: F.concat(F.date_format(d, "yyyyMMdd"), F.lit("0000"))
    clause = F.concat(F.lit("submittedDate:["), day(start), F.lit(" TO "), day(end), F.lit("]"))
    bad = month.isNotNull() & ~month.between(1, 12)
    return F.when(year.isNull(), "").when(bad, F.raise_error(F.lit("Month must be between 1 and 12")).cast("string")).otherwise(clause)


def search_query(keywords: Column, categories: Column, date_clause: Column) -> Column:
    """The query text: title terms, categories and dates, joined by AND; empty parts are left out."""
    titles = F.array_join(F.transform(keywords, lambda k: F.concat(F.lit("ti:"), k)), " AND ")
    kinds = F.when(F.size(F.coalesce(categories, F.array().cast("array<string>"))) > 0, F.concat(F.lit("("), F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR "), F.lit(")")))
    parts = F.filter(F.array(titles, kinds, date_clause), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), p, F.lit(")"))), " AND ")


def file_type(content: Column) -> Column:
    """``gzip``, ``pdf``, ``tar`` (by the mark of its first header), ``tex`` or ``unknown``, of a binary column."""
    text = F.try_validate_utf8(content)
    return (
        F.when(F.hex(F.substring(content, 1, 2)) == "1F8B", "gzip")
        .when(F.hex(F.substring(content, 1, 4)) == "25504446", "pdf")
        .when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar")
        .when(text.contains("\\document") | text.contains("\\begin{document}"), "tex")
        .otherwise("unknown")
    )


def python_float(c: Column) -> Column:
    """A double as Python writes it, for the sizes met in records: ``10000000.0``, not ``1.0E7``."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e16), F.concat(F.floor(c).cast("bigint").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def python_text(c: Column) -> Column:
    """A string literal as Python writes it."""
    bare = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), c)
    double = bare.contains("'") & ~bare.contains('"')
    return F.when(c.isNull(), "None").when(double, F.concat(F.lit('"'), bare, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(bare, F.lit("'"), F.lit("\\'")), F.lit("'")))


def python_list(c: Column, render=python_text) -> Column:
    """A list as Python writes it; null stays null."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, render), ", "), F.lit("]"))
