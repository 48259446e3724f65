"""Reading typed names of persons and organisations into comparable parts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Short and pet forms of given names (fixed values).
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alex": "alexander", "andy": "andrew", "sasha": "alexander", "barb": "barbara", "becky": "rebecca", "ben": "benjamin", "benny": "benjamin",
    "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "bill": "william", "billy": "william", "will": "william", "bob": "robert", "bobby": "robert", "rob": "robert",
    "charlie": "charles", "chris": "christopher", "kit": "christopher", "cathy": "catherine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "dan": "daniel", "danny": "daniel", "dave": "david",
    "dick": "richard", "rick": "richard", "dima": "dmitri", "mitya": "dmitri", "dot": "dorothea", "dora": "dorothea", "dolly": "dorothea", "ed": "edward", "ted": "edward", "ellie": "eleanor", "nell": "eleanor", "nora": "eleanor", "lena": "helena",
    "fred": "frederick", "freddie": "frederick", "greg": "gregory", "hank": "henry", "harry": "henry", "jack": "john", "jim": "james", "jimmy": "james", "joe": "joseph", "jo": "josephine", "josie": "josephine",
    "ken": "kenneth", "larry": "lawrence", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "peg": "margaret", "matt": "matthias", "mat": "matthias", "mike": "michael", "misha": "michael", "mick": "michael", "mandy": "amanda",
    "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "pete": "peter", "phil": "philip", "ron": "ronald", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susanna", "susie": "susanna", "suzy": "susanna",
    "sveta": "svetlana", "lana": "svetlana", "thea": "theodora", "theo": "theodora", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "tony": "anthony", "valya": "valentina", "val": "valentina", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vika": "victoria",
}
#: Titles before and after names, and marks of departments and kinds of organisations (fixed values).
TITLES = frozenset("dr prof professor mr mrs ms miss sir phd msc bsc md jr sr ii iii".split())
DEPARTMENTS = frozenset("department dept school faculty division section group chair departement faculte".split())
#: Words that tell what kind of organisation a name is of, and the kind they tell.
KINDS = {
    "u": "university", "university": "university", "univ": "university", "universite": "university", "universitat": "university", "universidad": "university",
    "institute": "institute", "inst": "institute", "institut": "institute", "technology": "", "technologies": "company", "tech": "", "language": "", "lang": "", "langtech": "company", "inc": "company", "ltd": "company", "gmbh": "company", "corp": "company", "corporation": "company",
    "library": "library", "bibliotheque": "library", "national": "", "nationale": "", "natl": "", "nat": "", "lib": "library",
    "laboratory": "labs", "laboratories": "labs", "labs": "labs", "lab": "labs", "research": "", "laboratoire": "labs",
    "centre": "centre", "center": "centre", "ctr": "centre", "speech": "", "studies": "", "stud": "", "etudes": "", "parole": "", "technologie": "", "recherche": "",
}
SMALL = frozenset("of for the de du des la le les et and a an at in fur der die das d l".split())


def plain(text: str) -> str:
    """Without accents, footnote marks, invisible characters; letters that don't decompose written out."""
    text = text.translate({0xF8: "o", 0xD8: "O", 0xDF: "ss", 0xE6: "ae", 0xC6: "Ae", 0x142: "l", 0x141: "L", 0xF0: "d", 0xFE: "th", 0x131: "i"})
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) not in ("Cf", "Cc") or c in " \t\n")


def skeleton(word: str) -> str:
    """One writing for spellings that differ by transliteration, and for doubled letters."""
    w = re.sub(r"[^a-z]", "", word)
    for a, b in (("sch", "sh"), ("tch", "ch"), ("ph", "f"), ("ou", "u"), ("y", "i"), ("w", "v"), ("z", "s"), ("x", "ks"), ("q", "k")):
        w = w.replace(a, b)
    w = re.sub(r"c(?!h)", "k", w)
    return re.sub(r"(.)\1+", r"\1", w)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours (restricted), or ``most + 1`` if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def _room(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


class Given:
    """Known given names: pet forms, and the most connected tokens of the data."""

    def __init__(self, known: frozenset[str]) -> None:
        self.known = known | frozenset(NICKNAMES.values())
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.known):
            self.by_length.setdefault(len(w), []).append(w)
        self.cache: dict[str, str | None] = {}

    def of(self, word: str) -> str | None:
        """The known name that ``word`` is, is short for, or is a slip of; None if there is none."""
        if word in NICKNAMES:
            return NICKNAMES[word]
        if word in self.known:
            return word
        if word not in self.cache:
            room = _room(word)
            near = [(d, w) for n in range(len(word) - room, len(word) + room + 1) for w in self.by_length.get(n, ()) if (d := edits(word, w, min(room, _room(w)))) <= min(room, _room(w))] if room else []
            self.cache[word] = min(near)[1] if near else None
        return self.cache[word]


@lru_cache(maxsize=4)
def given_names(known: frozenset[str]) -> Given:
    return Given(known)


def person_tokens(text: str) -> tuple[list[str], list[str], bool]:
    """``(tokens before the comma or all, tokens after it, whether there was a comma)``, as typed but plain."""
    t = plain(text)
    t = re.sub(r"\([^)]*\)|\[[^]]*\]|\^\S+", " ", t)
    t = re.sub(r"[^A-Za-z,.' -]+", " ", t)
    words = []
    for s in t.split(","):
        held = re.findall(r"[A-Za-z][A-Za-z'-]*", s.replace(".", " . "))
        words.append([w for w in held if w.lower().strip("-'") not in TITLES])
    words = [w for w in words if w]
    if not words:
        return [], [], False
    return words[0], [x for w in words[1:] for x in w], len(words) > 1


def person(text: str, known: frozenset[str], partners: dict[str, int] | None = None) -> tuple[str, str, str]:
    """``(given name or "", first initial or "", surname skeleton)`` of a typed person's name."""
    lex = given_names(known)
    head, tail, comma = person_tokens(text)

    def join(ws: list[str]) -> str:
        return re.sub(r"[^a-z]", "", "".join(ws).lower())

    if comma and head and tail:
        surname, given = head, tail
    else:
        ws = [*head, *tail]
        if not ws:
            return "", "", ""
        long = [w for w in ws if len(w.strip("-'")) > 1 and not re.fullmatch(r"([A-Z]-)+[A-Z]?", w)]
        if len(long) <= 1:
            surname = long or ws[-1:]
            given = [w for w in ws if w not in surname]
        else:
            upper = [w for w in long if w.isupper() and len(w) > 2]
            if upper and len(upper) < len(long):
                surname = upper
            else:
                first, last = re.sub(r"[^a-z]", "", long[0].lower()), re.sub(r"[^a-z]", "", long[-1].lower())
                swap = lex.of(last) is not None and lex.of(first) is None and not (len(long) > 2 and lex.of(join(long[:2])))
                surname = long[:1] if swap else long[-1:]
            given = [w for w in ws if w not in surname]
    full = [w for w in given if len(re.sub(r"[^A-Za-z]", "", w)) > 1 and not re.fullmatch(r"([A-Za-z]-)+[A-Za-z]?", w)]
    sk = skeleton(join(surname))
    letters = join(given)
    if full:
        name = join(full)
        name = lex.of(name) or (lex.of(join(full[:1])) if len(full) > 1 else None) or name
        return name, name[:1], sk
    return "", letters[:1], sk


def _kind_word(word: str) -> str | None:
    if word in KINDS:
        return word
    room = 1 if 5 <= len(word) < 8 else 2 if len(word) >= 8 else 0
    if not room:
        return None
    near = [(d, w) for w in KINDS if len(w) >= 5 and abs(len(w) - len(word)) <= room and (d := edits(word, w, room)) <= room]
    return min(near)[1] if near else None


@lru_cache(maxsize=100_000)
def _kind_of(word: str) -> str | None:
    return _kind_word(word)


def organisation(text: str) -> tuple[str, str]:
    """``(kind, skeleton of the own name)``; departments, places after the name and marks are left out."""
    t = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", plain(text)).lower()
    t = re.sub(r"\^\S+|[*†‡§]+", " ", t)
    # a short form in brackets goes, a name in brackets stays
    t = re.sub(r"\(([a-z]{1,5}|\d+)\)", " ", t).replace("(", ",").replace(")", " ")
    kind, own = "", ""
    words_seen: list[str] = []
    for segment in t.split(","):
        ws = [w for w in re.findall(r"[a-z]+", segment) if w not in SMALL]
        if not ws:
            continue
        if any(w in DEPARTMENTS or any(edits(w, d, 1) <= 1 for d in DEPARTMENTS if len(d) > 5) for w in ws) and not any(_kind_of(w) == "university" for w in ws):
            continue
        named = []
        for w in ws:
            k = _kind_of(w)
            if k is None:
                named.append(w)
            else:
                words_seen.append(k)
        if named and not own:
            own = "".join(named)
        if own and words_seen:
            break
    told = [KINDS[w] for w in words_seen if KINDS[w]]
    if "langtech" in words_seen or ("language" in words_seen or "lang" in words_seen) and any(w.startswith("tech") for w in words_seen):
        kind = "company"
    elif "institute" in told:
        kind = "institute"
    elif told:
        kind = told[0]
    elif words_seen and words_seen[0].startswith("tech"):
        kind = "institute"
    elif words_seen:
        kind = "-".join(sorted(set(words_seen)))
    if not own:
        own = "".join(words_seen)
    return kind, skeleton(own)
