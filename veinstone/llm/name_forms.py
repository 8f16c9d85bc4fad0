"""What a typed name says: given names with nicknames, titles, kinds of organisation, abbreviations, and edit distance.

The lists are fixed values: common English-language given names with their short forms, titles, legal forms and kinds of
organisation. They are parameters of `parse`, so another domain passes its own.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Given name and its short forms.
NICKNAMES = {
    "alexander": "alex sasha xander lex alec sandy", "alfred": "alf fred", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs",
    "benjamin": "ben benny benji", "catherine": "cathy cat", "charles": "charlie chuck", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dmitri": "dima mitya dimitri", "donald": "don donny",
    "dorothy": "dot dottie", "edward": "ed eddie ted ned", "elizabeth": "liz beth lizzy betty eliza libby bess", "eugene": "gene",
    "francisco": "paco pancho curro kiko", "frederick": "freddy fritz", "gabriel": "gabe", "george": "georgie", "gregory": "greg",
    "harold": "harry hal", "helena": "lena", "henry": "hank", "ingrid": "inga inge", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "jessica": "jess jessie", "johannes": "hannes hans", "john": "johnny jack", "jonathan": "jon jonny",
    "joseph": "joe joey", "katherine": "kate kathy katie kat kay", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "leo lenny len",
    "margaret": "maggie peggy meg marge greta", "martin": "marty", "matthew": "matt", "matthias": "matze hias", "michael": "mike mick mickey",
    "natalia": "natasha", "nathaniel": "nate", "nicholas": "nick nico nicky", "patricia": "pat patty trish", "pamela": "pam",
    "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich ricky richie", "robert": "rob bob bobby robbie bert",
    "ronald": "ron ronnie", "samuel": "sam sammy", "stephen": "steve", "susanna": "sue susie suzy sanna susan suse zuzana", "theodora": "thea dora teddy",
    "theodore": "theo", "thomas": "tom tommy", "timothy": "tim timmy", "victor": "vic", "victoria": "vicky tori vicki vika", "vladimir": "vova",
    "walter": "walt wally", "william": "will bill billy liam willy", "yekaterina": "katya", "zachary": "zach",
}
#: Titles before or after a person's name.
TITLES = "dr prof eng capt mr mrs ms miss sir col maj gen lt sgt ing phd md jr sr rev hon doctor professor captain engineer".split()
#: Words of an organisation's name that do not tell it from others.
IDLE = "the of and for a an group grp gmbh inc ltd sa ag plc llc llp co corp company corporation limited incorporated kg bv nv srl spa oy ab".split()
#: Words that say what kind of organisation it is.
KINDS = (
    "academy administration agency airlines airport alliance association authority aviation bank bros brothers bureau centre center chamber "
    "chemical clinic club college commission committee communications consortium cooperative council defence defense department "
    "development directorate education electric electricity energy engineering enterprise exchange federation finance fisheries forestry "
    "foundation fund gas government harbour health holding hospital housing industries industry institute insurance interior international "
    "investment laboratories laboratory labour library logistics media medical ministry mining motors municipal museum national navy network "
    "office oil operator party pharma police port postal power press project railway railways research river savings school science security "
    "services shipping society state station steel systems technical technologies technology telecom telecommunications television trade transport treasury "
    "trust union university utilities utility water works workshop "
    "badger bear bison bobcat buffalo cobra condor cougar coyote crane crow dingo dragon eagle falcon ferret fox gecko hawk heron hornet hyena ibis "
    "jackal jaguar kestrel kitten kraken lemur leopard lion lynx magpie mantis marten moth newt oriole osprey otter owl panda panther pelican phoenix puffin puma "
    "python raccoon raven scorpion shark shrike spider stoat tapir tiger toad typhoon viper vulture walrus wasp weasel wolf wolverine"
).split()

#: Usual abbreviations of these words.
SHORT_KINDS = {
    "assoc": "association", "auth": "authority", "bk": "bank", "bros": "brothers", "dept": "department", "eng": "engineering",
    "inst": "institute", "ins": "insurance", "intl": "international", "lab": "laboratory", "labs": "laboratories", "min": "ministry",
    "natl": "national", "res": "research", "rly": "railway", "sav": "savings", "tech": "technology", "telecom": "telecommunications",
    "univ": "university",
}

_CAMEL = re.compile(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})")
_CODE = re.compile(r"[A-Z]{1,6}|[A-Z]{1,6}[-_ ]?\d+|UNC\d+")


def plain(name: str) -> str:
    """Letters without marks, camel case and underscores as spaces."""
    marks = unicodedata.normalize("NFKD", name)
    return _CAMEL.sub(" ", "".join(ch for ch in marks if not unicodedata.combining(ch))).replace("_", " ")


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, over a band of width 2 * most + 1; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    beyond = most + 1
    before: list[int] = []
    last = [j if j <= most else beyond for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [beyond] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before[j - 2] + 1)
            row[j] = cost
        if min(row) > most:
            return beyond
        before, last = last, row
    return min(last[len(b)], beyond)


def segments(key: str, edits: int) -> list[tuple[int, int, str]]:
    """The edits + 1 pieces of a key: (index, start, text). After at most `edits` edits one piece survives, moved by at most `edits`."""
    parts, at, out = edits + 1, 0, []
    for n in range(parts):
        size = len(key) // parts + (n >= parts - len(key) % parts)
        out.append((n, at, key[at : at + size]))
        at += size
    return out


def _shortened(word: str) -> set[str]:
    """The word and what is left of it without one letter: two words one edit apart, a swap included, have one of these in common."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Lexicon:
    """Words with their entries, looked up exactly or one edit away (words of four letters or more)."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.entries = entries
        self.index: dict[str, list[str]] = {}
        for form in entries:
            if len(form) >= 4:
                for part in sorted(_shortened(form)):
                    self.index.setdefault(part, []).append(form)

    def near(self, word: str) -> str | None:
        """The form a word is or is one edit away from, the first of the lexicon's."""
        if word in self.entries:
            return word
        if len(word) < 3:
            return None
        found = {form for part in _shortened(word) for form in self.index.get(part, ()) if distance(word, form, 1) <= 1}
        return next((form for form in self.entries if form in found), None) if found else None


_GIVEN = Lexicon({form: name for name, forms in NICKNAMES.items() for form in [name, *forms.split()]})
_KINDS = Lexicon({k: k for k in KINDS} | SHORT_KINDS)


@lru_cache(maxsize=1 << 17)
def _given(word: str) -> tuple[str, str] | None:
    """(form, entry) of the given name a word is, or may be a misspelling of."""
    form = _GIVEN.near(word)
    return (form, _GIVEN.entries[form]) if form else None


@lru_cache(maxsize=1 << 17)
def _kind(word: str, dotted: bool) -> str | None:
    if dotted and word not in _KINDS.entries:
        return next((k for k in KINDS if abbreviates(word, k)), None)
    form = _KINDS.near(word)
    if form is None and len(word) > 4 and word.endswith("s"):
        form = _KINDS.near(word[:-2]) if word.endswith("es") and word[:-2] in _KINDS.entries else _KINDS.near(word[:-1])
    return _KINDS.entries[form] if form else None


def abbreviates(short: str, word: str) -> bool:
    """Whether short has the first letter of word and its letters in order, and is clearly shorter."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    at = 0
    for ch in short:
        at = word.find(ch, at) + 1
        if not at:
            return False
    return True


class Parsed(NamedTuple):
    """key: the part that must agree up to typing errors; sure: the given name (of the table, if it is exactly one of its forms, else
    as typed) or the kinds; initial: one that stands for the given name; form: the table's form that the given name is, or may be a
    misspelling of if guess, the name the form stands for, is given: only the corpus can tell."""

    key: str
    sure: str = ""
    initial: str = ""
    guess: str = ""
    form: str = ""


def parse(name: str | None, sub_type: str) -> Parsed | None:
    """What a name says; None for names that say nothing by themselves: null, blank, codes and acronyms."""
    if not name or not name.strip():
        return None
    if not re.search(r"[a-zA-Z0-9]", plain(name)):  # another script: all its letters, of which no part is told from another
        letters = "".join(ch for ch in plain(name).lower() if ch.isalnum())
        return Parsed(letters) if letters else None
    if sub_type == "org":
        if _CODE.fullmatch(name.strip()):
            return None
        keys, kinds = [], []
        for word, dot in re.findall(r"([a-z0-9]+)(\.?)", plain(name).lower()):
            if word in IDLE or (len(word) <= 1):
                continue
            kind = _kind(word, bool(dot) and len(word) < 6)
            (kinds if kind else keys).append(kind or word)
        return Parsed("".join(sorted(keys)) or "".join(sorted(kinds)), " ".join(sorted(set(kinds)))) if keys or kinds else None
    text = plain(name).strip()
    words = [w for w in re.findall(r"[a-z]+", text.lower()) if w not in TITLES or w == text.lower()]
    if not words:
        return None
    initials, full = [w for w in words if len(w) == 1], [w for w in words if len(w) > 1]
    given = [(w, g) for w in full if (g := _given(w))]
    exact = [(w, g) for w, g in given if g[0] == w]
    if exact and len(full) > len(exact):
        given = exact  # a family name may look like a misspelled given name
    if len(full) > 1 and len(given) == len(full):  # every word could be a given name: the order decides
        given = [given[-1] if re.match(r"\s*\w+,", text) else given[0]]
    last = [w for w in full if w not in [w for w, _ in given]]
    if not given and len(last) > 1 and not initials:  # a given name that is not in the list
        first = last.pop() if re.match(r"\s*[^,]+,", text) else last.pop(0)
        return Parsed("".join(last), first)
    if not last:
        return Parsed(given[0][0]) if given else None
    if not given:
        return Parsed("".join(last), "", initials[0] if initials else "")
    word, (form, entry) = given[0]
    return Parsed("".join(last), entry, "", "", form) if word == form else Parsed("".join(last), word, "", entry, form)
