"""Which language a short text is written in, which one a request asks for, and whether a text can be of a language at all.

Scripts that tell their language decide first. Among languages in Latin script the share of each language's function words does,
a word that several have counting less and a word with letters the language lacks against it. A text of a language without a list is still told from one that has: prose with hardly any
of a language's function words is not of it.
"""

from __future__ import annotations

import re

#: Frequent function words and small numbers by language, the more widely used languages first.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it was on with as by from at this were had has have been which before after their its an not be are or through into during while no our we you they when how what who whether if but will would can could there than more these those such any each all both about between over under since until most some many other one two three four five where why below per",
    "es": "el la los las lo de del y o pero un una unos unas en a al con sin por para sobre entre desde hasta que qué quien quién cual cuál como cómo cuando cuándo donde dónde es son fue fueron era ha han había ser estar está están no más muy también su sus se le les este esta estos estas ese esa esto aunque ya según tras durante mediante todo todos toda todas uno dos tres cuatro cinco",
    "fr": "le la les de du des et ou mais un une en dans sur pour par avec sans au aux ce cette ces qui que quoi quel quelle quels quelles dont où est sont était été a ont avait il elle ils elles on nous vous je se sa son ses leur leurs ne pas plus très comme comment après avant depuis pendant entre sous vers chez aussi même si quand tous toutes deux trois quatre cinq",
    "de": "der die das den dem des und oder aber in zu von mit für auf im ist sind war waren wird wurde wurden worden ein eine einen einem einer nicht auch als an aus bei nach über um am zum zur durch sich es er sie wir ihr ihre ihren sein seine noch nur wie wenn dass ob was wer wem wen welche welcher welches haben hat hatte hatten kein keine vor bis unter gegen während ohne seit zwischen alle mehrere dieser diese dieses wieder eins zwei drei vier fünf",
    "pt": "o a os as de do da dos das e ou mas um uma em no na nos nas com sem por para pelo pela sobre entre desde até que quem qual como quando onde é são foi foram era tem têm ser está não mais muito também seu sua seus suas se ao aos à às este esta isso após durante dois duas três quatro cinco",
    "it": "il lo la i gli le di del della dei delle e o ma un uno una in nel nella con senza per su sul sulla tra fra da dal dalla che chi come quando dove è sono era stato stata ha hanno essere non più molto anche suo sua suoi si al alla ai questo questa dopo durante due tre quattro cinque",
    "nl": "de het een en of maar in op van voor met zonder door naar aan uit bij over onder tegen tot dat die wie wat hoe als wanneer waar is zijn was waren werd werden wordt heeft hebben niet geen meer ook hun haar zich dit deze na tijdens twee drie vier vijf",
    "pl": "i w z na do się nie że to jest są był była było były o od po za dla jak przez przed ale lub oraz który która które ich jego jej tym tego także został została zostały przy ze dwa trzy cztery",
    "sv": "och att det i en ett som på är av för med till den har inte om var hade från kan men eller vid efter under sig de deras två tre fyra",
    "da": "og at det i en et som på er af for med til den har ikke om var fra kan men eller ved efter under sig de deres blev to tre fire",
    "tr": "ve bir bu için ile da de olarak olan gibi daha çok ama veya en sonra kadar tarafından değil iki üç",
    "cs": "a v na se je že to s z do o ale jako by byl byla bylo byly který která které pro po nebo jsou od dva tři",
    "ro": "și în de la cu pe un o care nu este sunt din pentru mai că au fost prin sau după doi trei",
    "hu": "a az és hogy nem is egy van volt meg csak de mint már után ez két három",
    "fi": "ja on ei oli että se ovat mutta kun myös joka tai jotka ole sen kaksi kolme",
    "id": "yang dan di dengan untuk dari pada ini itu tidak dalam adalah akan telah oleh ke dua tiga",
    "vi": "và của là có cho không được các trong với một những này đã hai ba",
}
#: Letters beside a to z that a language's own words have.
LETTERS = {
    "en": "", "es": "áéíñóúü", "fr": "àâæçéèêëîïôœùûüÿ", "de": "äöüß", "pt": "áâãàçéêíóôõú", "it": "àèéìíîòóùú", "nl": "éëïóöü", "pl": "ąćęłńóśźż", "sv": "åäöé", "da": "æøåé",
    "tr": "çğıöşüâî", "cs": "áčďéěíňóřšťúůýž", "ro": "ăâîșțşţ", "hu": "áéíóöőúüű", "fi": "äöå", "id": "é",
}
#: Scripts that tell their language, kana before the characters that Chinese shares.
SCRIPTS = {"ja": "぀-ヿ", "zh": "㐀-鿿", "ko": "가-힣", "ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "ar": "؀-ۿ", "he": "֐-׿", "th": "฀-๿", "hi": "ऀ-ॿ"}
#: Scripts without spaces, in which a character counts for a word.
DENSE = ("ja", "zh", "th")
#: How requests name a language to answer in.
NAMES = {
    "en": "english englisch inglés anglais inglese inglês 英文 英语 英語", "de": "german deutsch alemán allemand tedesco alemão 德文 德语", "fr": "french französisch francés français francese francês 法文 法语",
    "es": "spanish spanisch español espagnol spagnolo espanhol 西班牙文 西班牙语", "zh": "chinese chinesisch chino chinois cinese chinês 中文 汉语", "pt": "portuguese portugiesisch portugués portugais portoghese português 葡萄牙语",
    "it": "italian italienisch italiano italien 意大利语", "ru": "russian russisch ruso russe russo 俄文 俄语", "ja": "japanese japanisch japonés japonais giapponese japonês 日文 日语", "ko": "korean koreanisch coreano coréen 韩文 韩语",
    "nl": "dutch niederländisch neerlandés néerlandais olandese holandês", "pl": "polish polnisch polaco polonais polacco polonês", "ar": "arabic arabisch árabe arabe arabo",
}
_SETS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_OF: dict[str, list[str]] = {}
for _lang, _words in _SETS.items():
    for _w in _words:
        _OF.setdefault(_w, []).append(_lang)
#: Elided words before an apostrophe.
_ELIDED = {"l": ["fr", "it"], "d": ["fr", "it"], "qu": ["fr"], "n": ["fr"], "s": ["fr"], "c": ["fr", "it"], "j": ["fr"], "dell": ["it"], "all": ["it"], "nell": ["it"], "un": ["it"]}
_NAMED = {name: lang for lang, names in NAMES.items() for name in names.split()}
_ASK = re.compile(r"(?i)(?:\b(?:in|auf|en|em)\s+(?:the\s+)?|用)(" + "|".join(sorted(_NAMED, key=len, reverse=True)) + r")(?![a-zäöüßéèñ])(?:[^.!?。！？\n]{0,24}\blanguage\b)?")
_ANSWER = re.compile(r"(?i)\b(?:answer|reply|respond|response|write|written|antwort\w*|schreib\w*|respond\w*|responde|contesta|respuesta|escribe|répond\w*|réponse|rédige\w*|écri\w*|rispond\w*|scriv\w*|escrev\w*)\b|回答|答复|作答|回复|撰写")
_LETTER = re.compile("|".join(f"(?P<{lang}>[{chars}])" for lang, chars in SCRIPTS.items()))
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_FOREIGN = {lang: re.compile(rf"[^\Wa-z_\d{letters}'’]") for lang, letters in LETTERS.items()}
_MARKED = re.compile(r"[^\Wa-z_\d'’]")
_HAS_SCRIPT = re.compile("[" + "".join(SCRIPTS.values()) + "]")
#: Prose of at least so many words has some of its language's function words.
PROSE = 8


def _script(text: str, words: int) -> str | None:
    """The language its script tells, if most of the text is in it."""
    if not _HAS_SCRIPT.search(text):
        return None
    n: dict[str, int] = {}
    for m in _LETTER.finditer(text):
        n[m.lastgroup] = n.get(m.lastgroup, 0) + 1
    if n.get("ja", 0) * 8 > n.get("zh", 0):
        n["ja"] = n.get("ja", 0) + n.pop("zh", 0)
    lang = max(n, key=n.get)
    dense = lang in DENSE
    return lang if n[lang] >= 4 and (2 if dense else 0.5) * n[lang] >= words else None


def _hits(text: str) -> tuple[int, dict[str, float], dict[str, int]]:
    """(words, weighted hits less words with letters the language lacks, hits) of the languages in Latin script."""
    shown = _WORD.findall(text)
    words = [w.lower().replace("’", "'") for w in shown]
    weighted: dict[str, float] = {}
    plain: dict[str, int] = {}
    for w in words:
        langs = _OF.get(w) or (_ELIDED.get(w.split("'")[0], ()) if "'" in w else ())
        for lang in langs:
            weighted[lang] = weighted.get(lang, 0.0) + 1 / len(langs)
            plain[lang] = plain.get(lang, 0) + 1
    marks = not text.isascii() and weighted
    for marked in (w for w, x in zip(words, shown) if not w.isascii() and x[0].islower() and _MARKED.search(w)) if marks else ():  # names may be foreign
        for lang in weighted.keys() & _FOREIGN.keys():
            if _FOREIGN[lang].search(marked):
                weighted[lang] -= 0.5
    return len(words), weighted, plain


def language(text: str) -> str | None:
    """A language's code; None if the text is too short or mixed to tell. Of equals the more widely used language counts."""
    words, weighted, plain = _hits(text)
    if script := _script(text, words):
        return script
    if words < 3 or not weighted:
        return None
    best = max(_SETS, key=lambda lang: weighted.get(lang, 0.0))
    return best if plain[best] >= 2 and weighted[best] > 0 else None


def lacks(text: str, lang: str) -> bool:
    """Whether a text is prose, of PROSE different words or more, and is not of a language: few function words of it, or another
    script."""
    words, _, plain = _hits(text)
    script = _script(text, words)
    if script:
        return script != lang
    if 10 * plain.get(lang, 0) >= words or words < PROSE:
        return False
    return len({w for w in _WORD.findall(text.lower()) if len(w) > 1}) >= PROSE and (lang in _SETS or lang in SCRIPTS)


def asked(instruction: str) -> str | None:
    """The language an instruction explicitly asks the answer to be in."""
    for sentence in re.split(r"(?<=[.!?。！？])\s*|\n", instruction):
        if (m := _ASK.search(sentence)) and _ANSWER.search(sentence):
            return _NAMED[m[1].lower()]
    return None
