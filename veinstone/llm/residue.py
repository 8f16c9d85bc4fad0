"""Template residue and error pages: count normalised lines by host, subtract recurrent boilerplate, judge what is left.

A record is excluded only if what is left of it is residue: slots left unfilled, filler, an error message or a notice that scripts
are required outweigh content. Evidence inside quotation marks or in sentences that say something else is content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.session import stored

#: A line is boilerplate of its host if this many of the host's records have it, and this share of them.
LEAST_RECORDS, LEAST_SHARE = 5, 0.004

#: Names that a program's own variables go by; these are no unfilled slots.
VARIABLES = "HOME PATH USER USERNAME USERPROFILE APPDATA LOCALAPPDATA PROGRAMDATA PROGRAMFILES TEMP TMP TMPDIR WINDIR SYSTEMROOT SYSTEMDRIVE COMSPEC PUBLIC HOSTNAME COMPUTERNAME PWD SHELL LANG HOMEPATH HOMEDRIVE ALLUSERSPROFILE"
_WORD = r"[A-Za-z][\w.]*(?:[ _-][A-Za-z]\w*){0,3}"
#: How templates write a slot.
SLOTS = [
    rf"\{{\{{\s*{_WORD}\s*\}}\}}", rf"[$#]?\{{\s*{_WORD}\s*\}}", rf"<%=?\s*{_WORD}\s*%>", rf"\[\[\s*{_WORD}\s*\]\]", rf"@@\s*{_WORD}\s*@@", r"__[A-Z][A-Z_]*[A-Z]__",
    r"%[A-Z][A-Z_]+[A-Z]%", r"\$[A-Z][A-Z_]+[A-Z]\$", rf"«\s*{_WORD}\s*»", r"\bX{4,}\b",
    rf"\[\s*(?:TODO|TBD|TBC|FIXME|INSERT|Insert|insert|ENTER|Enter|enter|YOUR|Your|your|ADD|Add|add|NAME OF|name of)\b:?\s*(?:{_WORD})?\s*\]", r"\[[A-Z][A-Z ]+ HERE\]", r"<[a-z]+(?:[ _][a-z]+){0,3}>(?!\s*</)",
]
#: Stand-in text of templates.
FILLERS = [
    r"lorem ipsum", r"(?:sample|dummy|placeholder|filler|example|demo) (?:text|content|copy|paragraph|sentence|title|headline|page|article)", r"(?:text|heading|headline|title|content|caption|copy|subtitle|description|summary|body) (?:goes|comes) here",
    r"(?:type|put|insert|enter|write|add|place) (?:your|the|some) (?:text|content|title|copy|words?|heading|caption|description)(?: here)?", r"your (?:text|content|caption|title|heading|headline|copy|logo|name|company) (?:goes )?here", r"replace this (?:paragraph|text|sentence|content|copy|section)", r"(?:copy|content|text|body copy) to be (?:supplied|added|provided|written|determined|announced)",
    r"is a placeholder(?: for)?", r"do not publish", r"coming soon", r"hier (?:steht|kommt|folgt)(?: später| bald)? (?:der|ein|ihr) text", r"(?:muster|blind|beispiel|platzhalter|füll)text", r"text(?:o|e) (?:de ejemplo|de relleno|de prueba|à remplacer|d'exemple|provisoire|de remplissage)", r"faux texte",
    r"示例(?:文本|文字|内容)", r"此处(?:填写|输入|插入|添加)", r"占位(?:符|文本|内容)", r"请替换", r"测试(?:文本|内容)", r"under construction",
]
#: Words of the usual nonsense Latin.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "auctor congue cras curabitur dapibus diam dictum dignissim donec egestas eget erat eros etiam euismod facilisis felis feugiat fringilla fusce gravida hendrerit iaculis imperdiet integer interdum justo lacinia lacus laoreet lectus leo libero ligula lobortis luctus maecenas massa mattis mauris maximus metus mi molestie morbi nam nec neque nibh nunc odio orci ornare pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proin pulvinar purus quam quisque rhoncus risus rutrum sagittis sapien scelerisque semper sem sodales sollicitudin suscipit suspendisse tellus tincidunt tortor tristique turpis ultrices ultricies urna varius vehicula vel venenatis vestibulum vitae vivamus viverra volutpat vulputate".split()
)
#: What servers and sites say when they fail.
ERRORS = [
    r"\b(?:http |error |fehler |erreur |code |status )*(?:400|401|403|404|405|408|410|429|500|501|502|503|504)\b[ :–-]*(?:bad request|unauthori[sz]ed|forbidden|not found|method not allowed|request timeout|gone|too many requests|(?:internal )?server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|error|fehler|erreur|interner serverfehler|erreur interne|error interno)",
    r"(?:error|fehler|erreur|错误)[ :-]*(?:code )?(?:400|401|403|404|410|429|500|502|503|504)", r"\bnot found\b", r"\bforbidden\b", r"bad gateway", r"gateway time-?out", r"(?:service|site|page|temporarily) (?:is )?(?:temporarily )?unavailable", r"internal server error", r"too many requests", r"access denied", r"permission denied",
    r"(?:page|resource|address|url|file) (?:was |is |could |can )?(?:not|n't)(?: be)? (?:found|exist)", r"(?:page|address) (?:has moved|no longer exists|does not exist|doesn't exist)", r"no longer exists", r"(?:do not|don't) have permission", r"(?:address|ip|access|request)(?: address)? (?:has been|was|is) blocked", r"blocked by the site owner", r"unexpected condition", r"(?:could|can) ?not (?:connect to|reach) the (?:database|server)", r"(?:session|link|page|token) (?:has )?expired", r"down for maintenance", r"(?:something|it) (?:went wrong|broke)(?: on our (?:side|end))?",
    r"(?:fatal:? )?uncaught exception(?: in \S+)?(?: on line \d+)?", r"fatal error", r"stack trace", r"warning: \w+\(\)", r"did not answer in time", r"timed out", r"an error (?:has )?occurred", r"connection (?:refused|reset|closed)", r"could not finish your request",
    r"seite (?:wurde )?nicht gefunden", r"seite existiert nicht", r"existiert nicht mehr", r"zugriff verweigert", r"(?:interner )?serverfehler", r"nicht erreichbar", r"wartungsarbeiten",
    r"page introuvable", r"introuvable", r"accès (?:refusé|interdit)", r"erreur (?:interne|du serveur|serveur)", r"service indisponible", r"n'existe (?:plus|pas)",
    r"página no encontrada", r"no encontrad[ao]", r"acceso denegado", r"error interno(?: del servidor)?", r"servicio no disponible", r"ya no existe",
    r"页面不存在", r"未找到(?:页面|网页)?", r"找不到(?:页面|网页|服务器)", r"访问被拒绝", r"禁止访问", r"服务器(?:内部)?错误", r"服务不可用", r"网关超时",
]
#: Notices that scripts are required.
_JS = r"(?:java ?script|js|scripts?|ecmascript)"
SCRIPTS = [
    rf"(?:enable|activate|allow|turn on|switch on|activate)\W+(?:\w+\W+){{0,3}}?{_JS}", rf"{_JS}(?: execution)? (?:is|are|has been|have been|was|must be|need to be|have to be)(?: \w+)? (?:disabled|blocked|off|switched off|turned off|required|enabled|allowed|on)", rf"{_JS} and cookies", rf"(?:requires?|needs?|works? only with|without) {_JS}", rf"{_JS} (?:is )?(?:required|disabled|must be allowed)", r"\bnoscript\b", rf"does not (?:run|support|execute) {_JS}", r"checking your browser", rf"{_JS} execution", r"(?:blocked|disabled) by an extension",
    rf"{_JS} (?:aktivieren|einschalten|zulassen)", rf"aktivieren sie (?:bitte )?{_JS}", rf"{_JS} (?:ist )?(?:deaktiviert|erforderlich|benötigt)", rf"(?:activer|activez|autoriser|autorisez) {_JS}", rf"{_JS} est (?:désactivé|requis|nécessaire)", rf"(?:activ[ea]|habilit[ea]|permita) {_JS}", rf"{_JS} (?:está )?(?:desactivado|deshabilitado|requerido|necesario)", rf"(?:启用|开启|打开|允许) ?{_JS}", rf"{_JS} ?(?:已禁用|被禁用|未启用)",
]
#: What stands next to such messages and on every page, and says nothing by itself.
ASIDES = [
    r"^(?:oops|ups|hoppla|whoops|uh-oh|sorry)\W*$", r"réessayer", r"^(?:request |reference |incident |ray |error )?(?:id|number|reference|code|nummer|référence|vorgangsnummer)\b[ :#-]*[0-9a-f-]*$", r"\b(?:id|no|number|référence|referencia|vorgangsnummer|编号)[ :]*[0-9a-f]{6,}", r"^loading", r"reload the page", r"here is how to", r"contact (?:support|the administrator|us)", r"try again", r"(?:back|return) to (?:the )?(?:home|start|previous)", r"use the search", r"cookies? (?:must|have to|need to|should) be", r"cookies? to improve", r"use cookies", r"all rights reserved", r"^©", r"check the (?:address|url|spelling)",
    r"versuchen sie es (?:später|erneut)", r"wenden sie sich an", r"veuillez (?:vérifier|réessayer)", r"vérifier l'adresse", r"compruebe la dirección", r"inténtelo (?:de nuevo|más tarde)", r"código de referencia", r"请(?:检查|稍后|重试|联系)", r"takes a few seconds", r"(?:in|to use|to view|to read|to see) (?:your browser|this (?:page|site|application))",
]


def _any(patterns: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns), re.I)


_SLOT = re.compile("|".join(f"(?:{p})" for p in SLOTS))
_FILLER, _ERROR, _SCRIPT, _ASIDE = _any(FILLERS), _any(ERRORS), _any(SCRIPTS), _any(ASIDES)
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|(?<!\w)'[^'\n]+'(?!\w)|`[^`\n]+`|「[^」]+」|«[^»\n]+»")
_QUOTE = re.compile(r"[\"“„'`「«]")
_UNIT = re.compile(r"(?<=[.!?…])\s+(?=\S)|(?<=[。！？])")
_TOKEN = re.compile(r"[㐀-鿿]|\w+(?:['’]\w+)?")
_FIELD = re.compile(r"^\s*(?:\w+\.\w+\s*:|[\w ]{1,20},\S+$|\{\s*\"|\w[\w ]{0,20}[:=]\s*\S)")
_VARIABLE = re.compile(r"[{}$#%]+\s*(?:" + "|".join(VARIABLES.split()) + r")\s*[{}$%]+")


#: Texts of an alternative that are spelled out before a part of it is taken instead.
SPELLED = 200


def _needs(pattern: str) -> set[str]:
    """Literals, in lower case, of which every match of a pattern holds one: read off the parsed pattern, so none is forgotten."""

    def best(options: list[set[str]]) -> set[str]:
        width = lambda x: sum(1 + (ch > "⺀") for ch in x)
        return max((o for o in options if o), key=lambda o: (min(5, min(map(width, o))), -len(o)), default=set())

    def follow(parts) -> tuple[set[str] | None, set[str]]:
        """(all texts of a sequence, None if they are too many; literals it needs, empty if none are known)."""
        run, runs, whole = {""}, [], True
        for part in parts:
            spelled, needed = one(*part)
            if spelled is not None and len(run) * len(spelled) <= SPELLED:
                run = {a + b for a in run for b in spelled}
                continue
            whole = False
            runs += [run, needed]
            run = {""} if spelled is None else spelled
        runs.append(run)
        return (run if whole else None), best([r for r in runs if "" not in r])

    def one(op, arg) -> tuple[set[str] | None, set[str]]:
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}, {chr(arg).lower()}
        if name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            return {chr(v).lower() for _, v in arg}, {chr(v).lower() for _, v in arg}
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            return {""}, set()
        if name == "SUBPATTERN":
            return follow(arg[-1])
        if name == "BRANCH":
            found = [follow(x) for x in arg[1]]
            spelled = set().union(*[f[0] for f in found]) if all(f[0] is not None for f in found) else None
            return spelled, set().union(*[f[1] for f in found]) if all(f[1] for f in found) else set()
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, item = arg
            spelled, needed = follow(item)
            if (least, most) == (0, 1) and spelled is not None:
                return spelled | {""}, set()
            return None, needed if least else set()
        return None, set()

    return follow(re._parser.parse(pattern))[1]


def _hint(literals: set[str]) -> re.Pattern:
    """One pattern for all literals, as a tree of their first letters; a literal that holds another is left out."""
    kept = [x for x in literals if not any(y != x and y in x for y in literals)]

    def tree(rest: list[str]) -> str:
        if "" in rest:
            return ""
        heads: dict[str, list[str]] = {}
        for x in rest:
            heads.setdefault(x[0], []).append(x[1:])
        forms = [re.escape(h) + tree(t) for h, t in sorted(heads.items())]
        return forms[0] if len(forms) == 1 else f"(?:{'|'.join(forms)})"

    return re.compile(tree(kept))


_NEEDS = [_needs(p) for p in FILLERS + ERRORS + SCRIPTS]
if not all(_NEEDS):
    raise ValueError("a pattern without a literal can't be scanned for")
_HINT = _hint(set().union(*_NEEDS))
#: A slot has one of these, whatever is in it.
_OPENING = re.compile(r"[{<\[@%«$]|__|XXXX")


def slots(unit: str) -> list[str]:
    """The unfilled slots of a unit; a program's variables are none."""
    return [s for s in _SLOT.findall(_VARIABLE.sub(" ", unit))]


def _filler(plain: str, words: list[str]) -> bool:
    covered = sum(len(_TOKEN.findall(h[0])) for h in _FILLER.finditer(plain))
    if covered and (covered >= 0.25 * len(words) or 2 * sum(w in LATIN for w in words) >= len(words)):
        return True  # a sentence that only mentions stand-in text says something else
    return _nonsense(words)


def _nonsense(words: list[str]) -> bool:
    """Latin of the usual kind, or the same again and again."""
    n = len(words)
    if n < 3:
        return False
    different = set(words)
    if len(different) <= max(1, n // 4):
        return True
    return len(different) - len(different & LATIN) <= 0.25 * n and sum(w in LATIN for w in words) >= 0.75 * n


#: Kinds without which a record is no residue.
EVIDENCE = frozenset(["placeholder", "filler", "error_page", "script_notice"])


def _covered(pattern: re.Pattern, plain: str) -> tuple[int, int, bool]:
    """(tokens in matches, tokens in matches or in asides, whether a match leads) of a unit."""
    hits = [m.span() for m in pattern.finditer(plain)]
    if not hits:
        return 0, 0, False
    count = lambda spans: sum(len(_TOKEN.findall(plain[a:b])) for a, b in spans)
    free = [(a, b) for a, b in (m.span() for m in _ASIDE.finditer(plain)) if all(b <= x or a >= y for x, y in hits)]
    return count(hits), count(hits) + count(free), not plain[: hits[0][0]].strip()


@lru_cache(maxsize=1 << 16)
def evidence(unit: str) -> str | None:
    """The kind of residue a sentence or line is evidence of, None for other units. Units that recur are judged once."""
    low = unit.lower()
    words = _TOKEN.findall(low)
    if not words:
        return None
    if _OPENING.search(unit) and slots(unit):
        return "placeholder"
    plain = low.replace("’", "'")
    if _QUOTE.search(plain):
        plain = _QUOTED.sub(" ", plain)
    if not _HINT.search(plain.replace("ſ", "s").replace("ı", "i")):
        return "filler" if _nonsense(words) and len(_TOKEN.findall(plain)) >= 0.6 * len(words) else None
    weight = len(words)
    if _filler(plain, words) and len(_TOKEN.findall(plain)) >= 0.6 * weight:
        return "filler"
    for kind, pattern, least in (("script_notice", _SCRIPT, 0.25), ("error_page", _ERROR, 0.34)):
        covered, beside, leads = _covered(pattern, plain)
        if covered and (beside >= least * weight and weight <= 16 or beside >= 0.5 * weight or leads and weight <= 30 and covered >= 2):
            return kind
    return None


def kind_of(unit: str) -> tuple[str, int]:
    """(kind, weight) of one sentence or line: placeholder, filler, error_page, script_notice, aside, bare or content."""
    weight = len(_TOKEN.findall(unit.lower()))
    if not weight:
        return "bare", 0
    if kind := evidence(unit):
        return kind, weight
    return _other(unit, _QUOTED.sub(" ", unit.lower().replace("’", "'")), weight)


def _other(unit: str, plain: str, weight: int) -> tuple[str, int]:
    if weight <= 16 and _ASIDE.search(plain):
        return "aside", weight
    if _FIELD.match(unit):
        return "content", weight
    short = weight <= (12 if re.search(r"[㐀-鿿]", unit) else 7)
    return ("bare" if short and not re.search(r"[.!?。！？]\s*$", unit) else "content"), weight


def residue(lines: list[str], boilerplate: list[bool]) -> str | None:
    """The kind of residue a record is, None if it is content. lines: its lines; boilerplate: those recurrent on its host, which
    count for nothing unless they are evidence themselves."""
    weights: Counter[str] = Counter()
    units: Counter[str] = Counter()
    order: list[str] = []
    for line, recurrent in zip(lines, boilerplate):
        for unit in units_of(line):
            kind, weight = kind_of(unit)
            if recurrent and kind in ("content", "bare", "aside"):
                continue
            weights[kind] += weight
            units[kind] += 1
            order.append(kind)
    if units["placeholder"] and units["content"] <= (1.5 * units["placeholder"] if units["placeholder"] > 1 else 0):
        return "placeholder"
    if units["filler"] and weights["filler"] > weights["content"]:
        return "filler"
    notice = units["script_notice"] + units["error_page"]
    if notice and weights["content"] <= weights["script_notice"] + weights["error_page"] + weights["aside"]:
        if units["script_notice"] != units["error_page"]:
            return max(("script_notice", "error_page"), key=lambda k: units[k])
        return next(k for k in order if k in ("script_notice", "error_page"))
    return None


def units_of(line: str) -> list[str]:
    return _UNIT.split(line.strip())


def candidate(text: str) -> bool:
    """Whether a text could be residue: one of its units is evidence. Without any, `residue` finds nothing."""
    return any(evidence(unit) for line in text.split("\n") for unit in units_of(line))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[batch["text"].map(candidate).astype(bool)]


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for lines in batch["lines"]:
            rows = sorted(((r["pos"], r["line"], r["boiler"]) for r in lines), key=lambda r: r[0])
            found.append(residue([r[1] for r in rows], [r[2] for r in rows]))
        out = pd.DataFrame({"key": batch["key"], "residue": pd.Series(found, dtype="object", index=batch.index)})
        yield out[out["residue"].notna()]


def template_residue(records: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, residue) of the records that are residue.

    Lines are counted over all records of a host, by hash of the normalised line (lower case, digits as #, single spaces) and with
    map-side sums, so a host with a third of all records is spread. Null, empty and blank texts are no residue; a null host is a
    host of its own; a record is judged whole, however long; other columns are not read.
    """
    rows = records.select(F.col(key).alias("key"), F.coalesce(host, F.lit("")).alias("host"), F.col(text).alias("text")).where(F.trim("text") != "")
    norm = lambda c: F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\d+", "#"), r"\s+", " "))
    split = F.split("text", "\n")
    hashes = F.array_distinct(F.transform(F.filter(split, lambda x: F.trim(x) != ""), norm))
    counts = rows.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_RECORDS)
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    recurrent = stored(counts.join(hosts, "host").where(F.col("n") >= LEAST_SHARE * F.col("all")).select("host", "h"), "boilerplate")
    lines = rows.mapInPandas(_candidates, rows.schema).select("key", "host", F.posexplode(split).alias("pos", "line")).withColumn("h", norm(F.col("line")))
    marked = lines.join(recurrent.withColumn("boiler", F.lit(True)), ["host", "h"], "left")
    whole = marked.groupBy("key").agg(F.collect_list(F.struct("pos", "line", F.coalesce("boiler", F.lit(False)).alias("boiler"))).alias("lines"))
    return whole.mapInPandas(_judge, "key bigint, residue string").withColumnRenamed("key", key)
