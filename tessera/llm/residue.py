"""Documents that hold template residue, filler, error pages or notices instead of content.

Every text is read whole. It is split at its headings into bodies (LaTeX sections and
abstracts, Markdown headings, numbered or ``Abstract`` lines), a body into passages
(lines and sentences). A passage is residue if

* its TF-IDF containment in one exemplar is at least ``CONTAINED``: the weighted share
  of its letter 4-grams that the exemplar holds, found through an inverted index from
  4-grams to exemplars, where a 4-gram in no exemplar weighs most;
* or nothing is left of it (or only such a passage) without unfilled slots, like
  ``{{name}}``, ``[insert title]`` or ``%BODY%``, and field labels;
* or it is keyboard mash, or one or two words again and again.

A body is residue if at least ``WHOLE`` of its letters lie in such passages, so a text
that mentions, quotes or explains one is none. Passages are tried longest first and
left off as soon as that share is out of reach, which changes no result.

Defined results of the edge cases: null, empty and blank texts are no cases; page
numbers, tables, image marks, download links and other furniture of a page count
neither for nor against; damaged letters are left out before comparison; repeated
rows count once; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINED, WHOLE, GRAM = 0.6, 0.8, 4

#: Texts that stand in place of content (fixed values); their slots and numbers are left out.
EXEMPLARS = (
    # unfilled templates
    "The dataset contains in. It was published by under.", "The dataset contains samples collected from by (see Section ).", "Dear, the data described in contain items in.",
    "Section text pending; the editor will supply it.", "More details needed", "more information required - please edit", "More information needed", "to be completed", "to be added", "to be written", "coming soon", "to be announced", "to be determined",
    "fill in", "write up", "FIXME write up", "TODO write this section", "Your text goes here.", "Your text here", "Insert a short summary of the dataset at this place.", "Insert text here", "This is placeholder text. Replace it with your own paragraph before submission.",
    "Replace this paragraph by the real text of the section.", "Here comes the description of the data. Please write at least three sentences.", "Sample text.", "First Author and Second Author", "Section title", "Author list", "lipsum", "blindtext", "missingtext", "todo write",
    "Texte à compléter.", "Insérez ici le résumé du corpus.", "Texte provisoire à remplacer avant l'envoi.", "À remplir.",
    "نص مؤقت يُستبدل قبل الإرسال.", "أدخل وصف المجموعة في هذا المكان.", "Здесь будет описание корпуса.", "Введите описание набора данных в этом месте.", "Временный текст, замените его перед отправкой.", "Текст будет добавлен позже.",
    "ダミーテキストです。提出前に差し替えてください。", "ここに概要を入力してください。", "ここにデータセットの説明を入力してください。", "後で記入します。",
    "first bullet", "item one", "point A", "undefined", "text missing", "content missing", "abstract missing", "no text yet", "text to follow",
    "Contenu de remplissage, à remplacer avant l'envoi.", "Texte à venir.", "Здесь будет текст.", "Вставьте сюда описание корпуса.", "Вставьте сюда текст.", "يُكتب النص هنا لاحقًا.", "أدخل النص هنا.", "ここに本文を入力してください。", "説明文未記入", "本文未記入",
    # error pages and messages
    "Access denied You do not have permission to open on this server. Error reference", "Error code Bad Request Forbidden Not Found Unauthorized Internal Server Error Bad Gateway Service Unavailable Gateway Timeout Gone Try the following: check the address go back to the home page contact the desk of",
    "html head title Bad Gateway Forbidden Unauthorized Not Found Internal Server Error Service Unavailable Bad Request Gateway Timeout Too Many Requests Request Timeout Gone title head body h Bad Gateway Forbidden Unauthorized Not Found Internal Server Error Service Unavailable Bad Request h hr body html",
    "Bad Gateway", "Forbidden", "Unauthorized", "Not Found", "Page not found", "Internal Server Error", "Service Unavailable", "Bad Request", "Gateway Timeout", "Gone", "Too Many Requests", "Request Timeout",
    "error code message Bad Gateway Forbidden Unauthorized Not Found Internal Server Error Service Unavailable Bad Request Gateway Timeout Gone Too Many Requests request_id",
    "Upstream connect error or disconnect/reset before headers. reset reason: connection termination", "Upstream connect error or disconnect/reset before headers. reset reason: connection failure", "reset reason: connection timeout", "reset reason: overflow",
    "ERROR document conversion failed: no text layer", "document conversion failed: empty page tree", "document conversion failed: unsupported encryption", "document conversion failed: converter exited with status",
    "Traceback (most recent call last): File line in pages = reader.open(path) ValueError: not a document KeyError: pages TimeoutError: no answer", "OSError: Errno input/output error", "FileNotFoundError: Errno No such file or directory", "File extract.py, line in read_pdf", "Too many requests from this address. Retry after s.", "Rate limit exceeded. Retry after s.", "Quota exceeded. Retry after s.",
    "The resource has been removed by its owner.", "There is nothing here.", "Document withdrawn - no content", "File not found.", "No such paper", "Unable to render this file. Download the raw file instead.", "The requested URL could not be served. at port",
    "The requested URL was not found on this server.", "is down for maintenance since We will be back shortly.", "Oops! that link seems to be broken. Reference", "Sorry, something went wrong on our side. Reference", "Sorry, the file is no longer available for download. Reference", "Sorry, we can't find the page you are looking for. Reference",
    "Uh-oh. We are sorry", "this paper has been moved or withdrawn.", "Erreur La page demandée est introuvable ou a été déplacée.", "Désolé, le document n'existe plus sur", "Service momentanément indisponible, réessayez plus tard.", "Ошибка. Страница не найдена.", "Сервер временно недоступен. Попробуйте позже.",
    "خطأ: الصفحة غير موجودة.", "عذرًا، الخدمة غير متاحة حاليًا. حاول لاحقًا.", "お探しのページは見つかりませんでした。", "エラー お探しのページは見つかりませんでした。", "ただいまサーバーが混み合っております。しばらくしてから再度お試しください。",
    # notices
    "Please enable JavaScript to continue. Reload", "JavaScript is disabled in your browser. The reader of this repository does not work without it. Reload", "You need to enable JavaScript to run this app. Reload", "This site requires JavaScript. Turn on scripts in your browser and reload the page.",
    "noscript Scripts are switched off. Switch them on to view the abstract. noscript", "Please accept cookies and scripts, then try again.", "Cookies must be allowed to open this article.", "We use cookies to improve your experience. Accept all cookies", "Checking your browser before you reach This may take up to seconds. Ray",
    "Verify that you are a human: tick all pictures with a bridge.", "Complete the captcha to prove that you are not a robot.", "Login required User name: Password: Forgot password?", "Sign in to read the full text.", "Please sign in to continue.", "Your session has expired. Please log in again.",
    "Veuillez activer JavaScript dans votre navigateur pour afficher cette page.", "Accès refusé. Vous devez vous connecter pour lire ce document.", "Для просмотра этой страницы включите JavaScript в браузере.", "Доступ запрещён. Войдите в систему, чтобы открыть документ.",
    "يرجى تفعيل جافا سكريبت لعرض هذه الصفحة.", "تم رفض الوصول. يجب تسجيل الدخول أولًا.", "このページを表示するにはJavaScriptを有効にしてください。", "アクセスが拒否されました。ログインしてください。",
)
#: Passages of too few letters for 4-grams, and words of filler in place of Latin text (fixed values).
SHORT = frozenset("tbd tba tbc tk xxx null nan na none todo fixme s error erreur ошибка خطأ エラー 未定 準備中 作成中 記入予定".split())
FILLER = frozenset(
    "lorem ipsum dolor sit amet elit consectetur adipiscing sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur"
    " arcus auris corda ferro fugit labor magnas mollis novum nuntia pellet porta quidem risum sedet tempus velum vestra".split()
)

HEADING = re.compile(
    r"^[ \t]*(?:\\(?:sub)*section\*?\{[^\n]*\}?|\#{1,6}[ \t]+[^\n]+|\\(?:begin|end)\{abstract\}|\\begin\{document\}|\\maketitle|(?<=\n\n)\d{1,2}(?:\.\d+)*\.?[ \t]+[^\W\d_][^\n.:;!?。]{1,45}"
    r"|(?:Abstract|ABSTRACT|Summary|Résumé|Аннотация|Резюме|الملخص|ملخص|概要|要旨|Zusammenfassung)(?:[ \t]*$|[ \t]*[.:—][ \t]*))[ \t]*(?=\n|$|(?<=[.:—\t ])[^\n])",
    re.M,
)
DAMAGE = re.compile("Ã[©¨\xa0]?|[\ufb00-\ufb06\xad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\ufffd\ufe0f½¼¾…\ud800-\udfff]|[\U0001d400-\U0001d7ff\U0001f000-\U0001faff]|[\x00-\x08\x0b\x0e-\x1f\x7f]")
TABLE = re.compile(r"\\begin\{(table|tabular|figure)\*?\}.*?(?:\\end\{\1\*?\}|\Z)|^[ \t]*\|.*$", re.S | re.M)
FURNITURE = re.compile(
    r"^(?:\W*\d{0,4}\W*|<!-- *image *-->|\\(?:end|begin|label|maketitle|centering|noindent).*|Download ?PDF.*|.{0,16} - Cite - [\d.]+|Reload|\(c\).*|©.*|[a-z0-9-]+\.example|Reference:? *[0-9a-f]*|-{3,}|\*? ?[\"'{}\[\],]*)$", re.I
)
SLOT = re.compile(
    r"\{\{[^{}\n]{0,40}\}\}|\$\{[^{}\n]{1,40}\}|<%=?[^%\n]{1,40}%>|\{%[^%\n]{1,60}%\}|<!--[^\n]{1,60}?-->|@@?[A-Za-z_. ]{2,40}@@?|%[A-Za-z_. ]{2,40}%|__[A-Za-z][A-Za-z_. ]{0,40}?__|«[A-Za-z_. ]{2,40}»"
    r"|\{[^\W\d][\w. ]{1,40}\}|\[[^\W\d][\w. -]{1,40}\]|<[^\W\d][\w. -]{1,40}>|%[sd]\b|_{2,}"
)
LABEL = re.compile(r"""["']?[A-Za-z_][A-Za-z_ ]{1,20}["']?\s*[:=]""")
PART = re.compile(r"\n|[.!?؟]\s+|。")
HOST = re.compile(r"\b[a-z0-9-]+\.example\S*|/\S*\d\S*|\b(?=[a-f]*\d)[0-9a-f]+\b")
WORDS = re.compile(r"[^\W\d_]+")
MASH = re.compile(r"\b(?:[asdfghjkl]+|[qwertyuiop]+|[zxcvbnm]+)\b")


def clean(text: str) -> str:
    """``text`` without damaged and invisible letters, with one kind of line end."""
    out = DAMAGE.sub("", text.replace("\r\n", "\n").replace("\r", "\n").replace("\x0c", "\n"))
    return out if out.isascii() else unicodedata.normalize("NFKC", out)


def _letters(passage: str) -> str:
    return "".join(WORDS.findall(passage)).casefold()


def _grams(letters: str) -> set[str]:
    return {letters[i : i + GRAM] for i in range(len(letters) - GRAM + 1)}


@lru_cache(maxsize=1)
def index() -> tuple[dict[str, tuple[float, tuple[int, ...]]], float]:
    """The inverted index: the weight of each 4-gram and the exemplars that hold it; and the weight of all others."""
    held: dict[str, list[int]] = {}
    for i, text in enumerate(EXEMPLARS):
        for g in _grams(_letters(unicodedata.normalize("NFKC", text))):
            held.setdefault(g, []).append(i)
    n = len(EXEMPLARS) + 1
    return {g: (math.log(1 + n / len(at)), tuple(at)) for g, at in held.items()}, math.log(1 + n)


def containment(letters: str) -> float:
    """The greatest TF-IDF containment of ``letters`` in an exemplar."""
    postings, rare = index()
    grams = _grams(letters)
    known = [postings[g] for g in grams if g in postings]
    # no known 4-gram weighs more than an unknown one, so this share bounds the containment
    if not grams or len(known) < CONTAINED * len(grams):
        return 0.0
    total = rare * (len(grams) - len(known)) + sum(w for w, _ in known)
    scores: dict[int, float] = {}
    for w, at in known:
        for i in at:
            scores[i] = scores.get(i, 0.0) + w
    return max(scores.values(), default=0.0) / total


def _noise(passage: str) -> bool:
    """Filler words, keyboard mash, or one or two words again and again."""
    words = [w.casefold() for w in WORDS.findall(passage)]
    if len(words) >= 2 and len([w for w in words if w in FILLER]) >= 0.8 * len(words):
        return True
    if len(words) >= 4 and len(MASH.findall(" ".join(words))) >= 0.8 * len(words):
        return True
    return len(words) >= 5 and sum(n for _, n in Counter(words).most_common(2)) >= 0.8 * len(words)


def residue(passage: str) -> bool:
    """Whether a passage stands in place of content."""
    letters = _letters(HOST.sub(" ", passage))
    if letters in SHORT or containment(letters) >= CONTAINED or _noise(passage):
        return True
    rest, slots = SLOT.subn(" ", passage)
    if slots:
        kept = _letters(LABEL.sub(" ", rest))
        return not kept or kept in SHORT or containment(kept) >= CONTAINED or containment(_letters(rest)) >= CONTAINED
    return False


def body_is_residue(body: str) -> bool:
    """Whether at least ``WHOLE`` of the letters of ``body`` lie in passages of residue."""
    if "\\begin{" in body or "|" in body:
        body = TABLE.sub("", body)
    parts = [p for p in map(str.strip, PART.split(body)) if p and not FURNITURE.match(p)]
    if not parts:
        return bool(re.search(r"\?{3}|_{3}", body))
    parts.sort(key=len, reverse=True)
    room = (1 - WHOLE) * sum(map(len, parts))
    for p in parts:
        if not residue(p):
            room -= len(p)
            if room < 0:
                return False
    return True


def is_residue(text: str | None) -> bool:
    """Whether the whole text, or the whole body of one of its sections, is residue."""
    if not isinstance(text, str) or not text.strip():
        return False
    whole = clean(text)
    cuts = [(m.start(), m.end()) for m in HEADING.finditer(whole)]
    if not cuts:
        return body_is_residue(whole)
    ends = [s for s, _ in cuts[1:]] + [len(whole)]
    bodies = [b for (_, start), end in zip(cuts, ends) if (b := whole[start:end]).strip()]
    if any(map(body_is_residue, bodies)):
        return True
    # no section is residue, so the whole can be only if what stands before the first heading is, or if nothing but headings is there
    before = whole[: cuts[0][0]]
    return (not bodies or bool(before.strip()) and body_is_residue(before)) and body_is_residue(whole)


def found(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of every document that is or holds residue, once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[is_residue(t) for t in batch["text"]], ["doc_id"]]

    return documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long").distinct()


def corpus(documents: DataFrame) -> DataFrame:
    """The documents without those of :func:`found`, each once."""
    return documents.join(found(documents), "doc_id", "left_anti").dropDuplicates(["doc_id"]).select(documents.columns).where(F.col("doc_id").isNotNull())
