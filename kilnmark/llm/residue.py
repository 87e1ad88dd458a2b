"""Problem 10: template residue, filler, error pages and notices that scripts are needed, where content should be.

A notebook's text is cut into its prose, code and output cells by the layout it is stored in. A prose or output cell is
residue if every line of it is: unfilled placeholders (a grammar for each delimiter, with nothing but template words
around them), filler text, an error notice or page, or a notice that scripts are needed. Context and density discount
the rest: code cells and fenced blocks are never judged, a cell with a sentence of other content isn't residue, so
tutorials that quote such strings and error traces pass, and what a notice leaves open may be at most a multiple of its
fixed words. No length of a cell, line or sentence decides anything.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# ---- Placeholders ----------------------------------------------------------------------------------------------

_FIELD = r"[a-z][\w.]*(?:[ _-]+[a-z][\w.]*){0,3}"
# The delimiters of common template languages and forms, around a field name.
_DELIMITED = [
    rf"\{{\{{\s*{_FIELD}\s*\}}\}}",
    rf"\$\{{\s*{_FIELD}\s*\}}",
    rf"#\{{\s*{_FIELD}\s*\}}",
    rf"\[\[\s*{_FIELD}\s*\]\]",
    rf"<%=?\s*{_FIELD}\s*%>",
    rf"@@\s*{_FIELD}\s*@@",
    rf"%\(\s*{_FIELD}\s*\)[sd]",
    rf"\{{%\s*block\s+{_FIELD}\s*%\}}\s*\{{%\s*endblock\s*(?:{_FIELD}\s*)?%\}}",
    rf"«\s*{_FIELD}\s*»",
    rf"<<\s*{_FIELD}\s*>>",
    rf"(?<!\w)__[a-z][a-z0-9]*(?:[ _-][a-z0-9]+)*__(?!\w)",
    rf"[\[<]\s*(?:your|insert|enter|add)\s+{_FIELD}\s*[\]>]",
    r"(?<!\w)todo\s*:\s*(?:describe|add|write|insert|fill in|replace|complete|explain)\s+[\w ]+",
]
PLACEHOLDER = re.compile("|".join(_DELIMITED))
# Words that template lines have around their placeholders.
GLUE = frozenset("dear hello hi welcome to author date by from title name version of and for the in on at is a an this regards thanks project notebook org".split())
# Field names that stay behind, set apart by blanks, where a delimiter was lost.
FIELDS = frozenset("author contact course dataset path description due date figure caption first last name license notebook org organisation organization project title region summary email version year".split())
# Long documents repeat few field shapes, so words are compared, not patterns.
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")

# ---- Filler ----------------------------------------------------------------------------------------------------

# Words of the usual pseudo-Latin filler text.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "ante arcu augue diam felis lacus massa mattis nibh nunc odio orci porta purus risus sem tellus urna vel vitae vestibulum pellentesque tincidunt turpis".split()
)
_FILLER = [
    r"placeholder (?:\w+ )?\d+ of \d+",
    r"placeholder(?: text| content| image| paragraph| section| cell)?",
    r"(?:sample|dummy|example|filler|placeholder) (?:paragraph|text|content|heading|caption)",
    r"(?:please )?replace (?:it|this|me|this text) with your own (?:words|text|content)",
    r"your (?:own )?(?:heading|body text|text|title|content|caption|subtitle|words|description|paragraph) (?:goes|go|will go) here",
    r"(?:your|insert|add|enter) (?:text|content|title|heading) here",
    r"this (?:space|page|section|cell|paragraph|text|area) (?:is|was) (?:intentionally )?(?:left blank|filled with dummy text|filler text|a placeholder|dummy text|placeholder text)",
    r"votre texte ici|insérez votre texte ici|remplacez ce texte",
    r"hier steht (?:später |bald )?ihr text|ihr text hier|platzhaltertext|blindtext",
    r"(?:escriba|escribe|inserte|ingrese|añada) aqu[ií] su (?:contenido|texto|título)|(?:su|tu) (?:texto|contenido) aqu[ií]|texto de ejemplo|(?:o )?seu texto aqui|il tuo testo qui",
    r"coming soon|content goes here|to be written",
]

# ---- Error notices ---------------------------------------------------------------------------------------------

_THING = r"(?:page|file|document|notebook|address|url|content|contents|cell contents|request|resource|server|service|preview|site|session|view|viewer|app|application|output|image|data|link|location|item|repository|kernel|host)"
_SERVICE = r"(?:(?:the|our|this|your|that|an|a) (?:[\w-]+ ){0,3}[\w-]+|we|it|you)"
_FAILS = r"(?:could not|couldn['’]t|cannot|can['’]t|can not|failed to|fails to|(?:is|was|were|are) (?:currently |temporarily )?unable to|refused to|refuses to|declined to|did not manage to|was not able to|were not able to)"
_ACT = r"(?:load|open|find|render|fetch|display|show|reach|serve|process|complete|read|connect to|access|locate|retrieve|get|deliver|preview|resolve|handle|be (?:delivered|served|retrieved|fetched|accessed|found|loaded|displayed|reached|opened|shown|rendered|processed|completed))"
_ERRORS = [
    rf"{_SERVICE} {_FAILS} {_ACT}(?: (?:the|this|that|your|our|a|an|any)(?: \w+){{0,3}} {_THING})?",
    rf"(?:the|this|that|your|a) (?:\w+ )?{_THING} (?:you (?:requested|asked for|are looking for|were looking for|wanted) )?(?:could not|cannot|can['’]t) {_ACT}",
    rf"{_SERVICE} (?:has )?(?:lost (?:the |its )?connection(?: to ([\w ]+))?|ran out of time(?: ([\w ]+))?|timed out(?: ([\w ]+))?|took too long(?: to ([\w ]+))?|did not respond(?: in time)?|(?:is|was) (?:currently |temporarily )?(?:unavailable|overloaded|offline|down(?: for maintenance)?|not available|not responding))",
    r"(?:the |this |your )?(?:\w+ )?(?:page|file|document|url|address|notebook)(?: you requested)? (?:was not found|is not found|not found|does not exist|no longer exists|has been (?:moved|removed|deleted)|has moved)",
    r"(?:this|the|that) (?:\w+ )?(?:file|notebook|document|output|page|image|cell) is too (?:big|large|long) to (?:display|show|preview|render|be displayed|be shown)",
    r"(?:access|permission|authori[sz]ation) (?:is |was )?(?:denied|forbidden|required)(?: to ([\w ]+))?",
    r"you (?:do not|don['’]t) have (?:the )?permissions? (?:to ([\w ]+)|for ([\w ]+))",
    r"your (?:session|login|token|access|link) (?:has |is )?(?:expired|ended|timed out)",
    r"(?:we(?:['’]re| are) )?(?:sorry|oops|whoops|uh oh)(?:[,!: ]+(?:but )?(?:something went wrong|an (?:unexpected )?error (?:has )?occurred|there was (?:a|an) (?:\w+ )?(?:problem|error)|this page ([\w ]+)|we ([\w' ]+)))?",
    r"something went wrong|an (?:unexpected |internal |unknown )?error (?:has )?occurred|there was (?:a|an) (?:\w+ )?(?:problem|error)(?: ([\w ]+))?",
    r"(?:(?:http )?(?:error|status)(?: code)?:? )?[45]\d\d:?(?: -)? (?:error|not found|forbidden|unauthorized|bad request|bad gateway|internal server error|service unavailable|gateway time-?out|too many requests|gone|request timeout|payload too large)",
    r"(?:page |file )?not found|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|too many requests|bad request|forbidden|unauthorized|request timed out|connection (?:refused|reset|timed out|closed)",
    r"upstream connect error(?: or disconnect before headers)?",
    r"seite (?:wurde )?nicht gefunden|die (?:angeforderte |gewünschte )?seite (?:existiert nicht(?: mehr)?|wurde nicht gefunden|konnte nicht ([\w ]+))|zugriff verweigert|es ist ein (?:\w+ )?fehler aufgetreten|interner serverfehler|ihre sitzung ist abgelaufen",
    r"(?:erreur ?: ?)?(?:cette|la) page (?:demandée )?(?:n['’]existe (?:pas|plus)(?: ou plus)?|est introuvable|n['’]a pas été trouvée)|page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|une erreur (?:est survenue|s['’]est produite)|votre session a expiré",
    r"(?:error ?: ?)?(?:esta |la )?página (?:solicitada )?(?:no (?:encontrada|existe(?: más)?|se encontró|se ha encontrado|disponible)|não (?:encontrada|existe))|acceso denegado|acesso negado|(?:se ha producido|ha ocurrido|ocurrió|ocorreu) um?n? error?|su sesión ha (?:caducado|expirado)|pagina non trovata",
]

# ---- Notices that scripts are needed ---------------------------------------------------------------------------

_SCRIPT = r"(?:java ?scripts?|js|scripts?|scripting|client-side (?:scripts?|scripting|code)|active scripting|active content)"
_NOTICES = [
    rf"(?:please )?(?:turn on|enable|activate|switch on|allow) {_SCRIPT}(?: ([\w ,'’-]+))?",
    rf"you (?:need|have|must|will need|should)(?: to)? (?:enable|turn on|activate|allow|have|switch on) {_SCRIPT}(?: ([\w ,'’-]+))?",
    rf"(?:[\w'’-]+ ){{1,4}}(?:does|do|will|can|may)(?: not|n['’]t) (?:work|run|load|open|be shown|be displayed|function|display)(?: \w+)? without {_SCRIPT}(?: (?:enabled|support|turned on|switched on))?",
    rf"(?:[\w'’-]+ ){{1,4}}(?:requires?|needs?) {_SCRIPT}(?: (?:to ([\w ]+)|enabled|support))?",
    rf"(?:it (?:looks|seems|appears) (?:like|that) )?(?:your browser|you) (?:has|have|is|blocks?|does not support|doesn['’]t support|is blocking)(?: got)? ?{_SCRIPT}?(?: (?:switched|turned) off| disabled| blocked)?[;,:]? ?(?:(?:[\w'’-]+ ){{1,5}}(?:cannot|can['’]t|could not|will not) (?:be )?(?:\w+))?",
    rf"{_SCRIPT} (?:is|are|must be|has been|needs to be) (?:required|disabled|turned off|switched off|needed|not enabled|enabled|blocked)(?: ([\w ,'’-]+))?",
    rf"if (?:nothing happens|this does not load|nothing appears|the page does not load|([\w ]+)),? (?:please )?(?:allow|enable|turn on|activate) {_SCRIPT}(?: ([\w ,'’-]+))?",
    rf"bitte (?:aktivieren sie )?{_SCRIPT}(?: in ihrem browser)?(?: aktivieren| einschalten| erlauben)?(?:,? um ([\w ]+))?|{_SCRIPT} (?:ist|wird) (?:deaktiviert|benötigt|erforderlich)(?: ([\w ]+))?|diese \w+ benötigt {_SCRIPT}",
    rf"(?:se requiere|necesita|es necesario(?: activar)?|active|habilite|debe (?:activar|habilitar)|por favor,? (?:active|habilite)) {_SCRIPT}(?: ([\w ]+))?",
    rf"(?:veuillez activer|merci d['’]activer|vous devez activer|il faut activer|activez) {_SCRIPT}(?: ([\w'’ ]+))?|{_SCRIPT} est (?:requis|nécessaire|désactivé)(?: ([\w'’ ]+))?",
    rf"(?:ative|habilite|é necessário(?: ativar)?|por favor,? (?:ative|habilite)|abilita|è necessario abilitare) {_SCRIPT}(?: ([\w ]+))?",
]

# ---- What may follow such notices ------------------------------------------------------------------------------

_TAILS = [
    r"(?:please )?(?:try|retry)(?: it)?(?: again)?(?: later| in \d+ \w+| shortly| soon)?|retry (?:in|after) \d+ \w+",
    r"(?:please )?(?:go|click) back(?: to ([\w ]+))?|(?:please )?return to ([\w ]+)|zurück zur \w+|retour à l['’ ]?\w+|volver al? \w+(?: \w+)?",
    r"(?:please )?contact (?:the |our |your )?([\w ]+)",
    r"(?:please )?(?:reload|refresh)(?: (?:the|this) page)?|please wait|loading(?: ([\w ]+))?|redirecting(?: ([\w ]+))?",
    r"(?:please )?(?:sign|log) in(?: again)?(?: to ([\w ]+))?",
    r"(?:error |status )?(?:code|reference|ref|trace|id|request(?: id)?|incident|ray id)[ :#]*[\w-]+|reset reason ?:? ?([\w ]+)",
    r"click to edit|add a caption|edit me|read more|learn more",
    r"thank you|thanks(?: for your patience)?|we apologi[sz]e(?: for ([\w ]+))?",
    r"(?:gateway|nginx|apache|cloudflare|server|proxy)(?:/[\d.]+)?",
]

_STRONG = re.compile("(?:" + "|".join(f"(?:{p})" for p in [*_FILLER, *_ERRORS, *_NOTICES]) + ")")
_TAIL = re.compile("(?:" + "|".join(f"(?:{p})" for p in _TAILS) + ")")
_DOTS = re.compile(r"[.…_=\-–—*\s]{3,}")
_TAG = re.compile(r"</?(?:b|p|i|u|em|hr|br|h\d|div|span|strong|center|small|pre|section|article|html|head|body|title|meta|noscript|font|main|header|footer)\b[^>]*>|<!doctype[^>]*>|<\?xml[^>]*>|<!--(?:(?!-->).)*-->")
_ERROR_PAGE = re.compile(r"\s*(?:(?:<!doctype[^>]*>|<\?xml[^>]*>|<!--(?:(?!-->).)*-->)\s*)*<html.*<title>\s*(?:error\s*)?[45]\d\d\b.*</html>\s*", re.S)
_NOSCRIPT = re.compile(r"<noscript[^>]*>(?:(?!</noscript>).)*</noscript>", re.S)
_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[ \t]*$|\Z)", re.M | re.S)
_ERROR_JSON = re.compile(r"""\{\s*["'](?:status|code|error|statuscode|status_code)["']\s*:\s*(?:["']?[45]\d\d["']?|\{|["'])[^{}]*\}?\s*\}""")
SPARSE = 4  # words that a notice may leave open, as a multiple of its fixed words
_ANSI = re.compile(r"\x1b\[[0-9;]*m")
_MARK = re.compile(r"^(?:(?:[#>*+!|-]+|\d+[.)]|\[(?:notice|info|warning|error|note|warn)\]|(?:notice|info|warning|note):)\s+)+")
_BRACKETED = re.compile(r"\s*\((?:(?:code|ref|error|id|trace|reference|status)?[ :#]*[\w-]+)\)")
_SMILE = re.compile(r"\s*(?:[:;]-?[()/|]|☹️?|🙁|😞)\s*$")
_SENTENCE = re.compile(r"[.!?…]+(?:\s+|$)|\s*[|]\s*|\n")


def _squeezed(line: str) -> str:
    return " ".join(line.split())


def repeated(line: str) -> bool:
    """Whether a line is one unit of up to four words at least four times over; the last one may be cut short."""
    words = line.rstrip(".!…").split()
    return any(len(words) >= 4 * k and words[k:] == words[:-k] for k in range(1, 5))


def _dense(m: re.Match | None) -> bool:
    """Whether what a notice leaves open is at most SPARSE times its fixed words: a density that holds at any length."""
    if m is None:
        return False
    free = sum(len(g.split()) for g in m.groups() if g)
    return free <= SPARSE * (len(m.group().split()) - free)


def line_kind(line: str) -> int:
    """2: residue by itself, 1: may stand beside residue, 0: other content. line: in small letters, without tags."""
    s = _squeezed(line)
    if not s:
        return 1
    bare = PLACEHOLDER.sub("\0", s)
    if "\0" in bare:
        return 2 if all(w in GLUE or w in FIELDS for w in _WORD.findall(_BRACKETED.sub("", bare))) else 0
    if _DOTS.fullmatch(s):
        return 1
    s = _SMILE.sub("", _BRACKETED.sub("", s)).strip()
    if repeated(s):
        return 2
    words = _WORD.findall(s)
    if not words:
        return 1
    if len(words) <= 3 and all(w in FIELDS for w in words):
        return 1
    if len(words) >= 4 and all(w in LATIN for w in words):
        return 2
    best = 1
    for part in _SENTENCE.split(s):
        part = part.strip(" .,:;!?…*_\"'`()-")
        if not part:
            continue
        if _dense(_STRONG.fullmatch(part)):
            best = 2
        elif not _dense(_TAIL.fullmatch(part)):
            words = _WORD.findall(part)
            if len(words) >= 4 and all(w in LATIN for w in words):
                best = 2
            else:
                return 0
    return best


def is_residue(cell: str) -> bool:
    """Whether a cell's text is nothing but residue. Empty and blank cells aren't, nor cells with a fenced block: what
    stands there is shown as code, as tutorials do."""
    if not cell or cell.isspace():
        return False
    text = _ANSI.sub("", cell).replace("\xa0", " ").casefold()
    if _FENCE.search(text):
        return False
    if "<noscript" in text:
        text = _NOSCRIPT.sub(" | this page requires scripts | ", text)
    if "<html" in text and _ERROR_PAGE.fullmatch(_MARK.sub("", text.strip())):
        return True
    strong = False
    for line in text.split("\n"):
        if not line.strip():
            continue
        line = _MARK.sub("", line.strip())
        if "{" in line and _ERROR_JSON.fullmatch(_BRACKETED.sub("", _TAG.sub(" ", line)).strip(" .!")):
            strong = True
            continue
        if "<html" in line and _ERROR_PAGE.fullmatch(line.strip(" .!")):
            strong = True
            continue
        kind = line_kind(_MARK.sub("", _TAG.sub(" ", line).strip()))
        if not kind:
            return False
        strong |= kind == 2
    return strong


# ---- Cells of the layouts --------------------------------------------------------------------------------------


def _joined(x) -> str:
    return "".join(map(str, x)) if isinstance(x, list) else x if isinstance(x, str) else ""


def _json_cells(text: str) -> list[str] | None:
    try:
        nb = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(nb, dict):
        return None
    cells = nb.get("cells")
    if cells is None and isinstance(nb.get("worksheets"), list):
        cells = [c for w in nb["worksheets"] if isinstance(w, dict) for c in w.get("cells") or []]
    if not isinstance(cells, list):
        return None
    out = []
    for c in cells:
        if not isinstance(c, dict):
            continue
        if c.get("cell_type") != "code":
            out.append(_joined(c.get("source")))
            continue
        for o in c.get("outputs") or []:
            if not isinstance(o, dict) or o.get("output_type") in ("error", "pyerr"):
                continue
            data = o.get("data") if isinstance(o.get("data"), dict) else {}
            for part in (o.get("text"), data.get("text/plain"), data.get("text/html"), data.get("text/markdown")):
                if part:
                    out.append(_joined(part))
    return out


_LEADER = re.compile(r"#+=? ?")


def _script_cells(text: str) -> list[str]:
    """Percent script: marked prose with '# ' (or '#= ') before each line, '#> ' before lines of output, the rest code.
    A line that isn't commented out ends the prose."""
    out: list[str] = []
    prose: list[str] | None = None
    output: list[str] = []
    for line in [*text.split("\n"), "# %%"]:
        if output and not line.startswith("#>"):
            out.append("\n".join(output))
            output = []
        if line.startswith("# %%"):
            if prose:
                out.append("\n".join(prose))
            prose = [] if "[markdown]" in line or "[raw]" in line else None
        elif line.startswith("#>"):
            output.append(line[3:] if line.startswith("#> ") else line[2:])
        elif prose is not None and (line.startswith("#") or not line.strip()):
            prose.append(_LEADER.sub("", line))
        elif prose is not None:
            out.append("\n".join(prose))
            prose = None
    return out


_IN, _OUT = re.compile(r"In \[[\d ]*\]:"), re.compile(r"Out\[[\d ]*\]:")


def _blocks(text: str) -> list[str]:
    return re.split(r"\n[ \t]*\n", text)


def _transcript_cells(text: str) -> list[str]:
    """Prose as paragraphs; 'In [n]:' starts code, 'Out[n]:' an output; each ends at a blank line."""
    out = []
    for b in _blocks(text):
        b = b.strip("\n")
        if _IN.match(b):
            continue
        m = _OUT.match(b)
        out.append(b[m.end() :] if m else b)
    return out


def _markdown_cells(text: str) -> list[str]:
    """Prose as paragraphs; fenced code, fenced text output, output set in by four blanks."""
    out: list[str] = []
    for i, part in enumerate(re.split(r"^```", text, flags=re.M)):
        if i % 2:
            kind, _, body = part.partition("\n")
            if kind.strip() in ("", "text", "output", "html", "json", "txt"):
                out.append(body)
            continue
        for b in _blocks(part):
            lines = b.strip("\n").split("\n")
            if all(x.startswith("    ") or not x.strip() for x in lines):
                out.append("\n".join(x[4:] for x in lines))
            else:
                out.append(b)
    return out


def cells(text: str, layout: str | None) -> list[str]:
    """The prose and output cells of a text; paragraphs where the layout doesn't mark the borders of prose cells, none
    in a script or notebook file that has no cells, which can only be residue as a whole."""
    if layout == "json" or layout is None and text.lstrip()[:1] == "{":
        return _json_cells(text) or []
    if layout == "script":
        return _script_cells(text)
    if layout == "transcript":
        return _transcript_cells(text)
    if layout == "markdown":
        return _markdown_cells(text)
    return _blocks(text)


def judged(text: str, layout: str | None) -> int:
    """Number of residue cells of a text; at least 1 if the whole text is residue."""
    n = sum(is_residue(c) for c in cells(text, layout))
    return n or int(is_residue(text))


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, residue_cells of the documents that have at least one cell of nothing but residue.

    Null, empty and blank texts have none; an unknown or null layout is read as paragraphs. Repeated rows are each judged; extra columns are ignored; an empty table gives an empty result."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [judged(t.as_py(), f.as_py()) if t.is_valid else 0 for t, f in zip(b.column(1), b.column(2), strict=True)]
            keep = pa.array([x > 0 for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc_id", "residue_cells"]).filter(keep)

    return documents.selectExpr("cast(doc_id as long) as doc_id", "text", "nb_format").mapInArrow(judge, "doc_id long, residue_cells int")
