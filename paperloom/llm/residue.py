"""Template residue, filler, error messages and demands for scripts where real
content belongs.

A regularised linear classifier tells four kinds of segments (a block of a
page, a line of a note): real text, residue (a placeholder where a value
belonged), notices (errors, demands for scripts) and filler. Its features are
hashed character n-grams, the segment's length, its place (heading, code,
front matter) and its relation to the record's title. It learns from weak
labels: a response status or a phrase labels the short record it stands in,
the shape of a segment that is a label and a placeholder labels residue, and
records that show their own title label what real text looks like. Residue is
judged by the sentence around each placeholder: unfilled slots against texts
that speak of placeholders. Every kind but real text needs a probability that
was chosen on hosts and phrases the classifier hasn't seen.

A record is a case if a segment is residue, or if it has notices or filler and
neither its own title as a heading (pages) nor a segment of real text (notes).

Only the fit reads a sample, of at most ``SAMPLE`` records of a table chosen
by a hash of their keys and none beyond ``SAMPLE_CHARS``; every record is
scored, over its whole text.

Defined results: null or empty texts are no cases; a record delivered more
than once is a case if one delivery is; ties between kinds go to real text.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from http import HTTPStatus

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.unify import one_form

#: Most records of a table the classifier is fitted on.
SAMPLE = 4000
#: Records longer than this are not used for fitting (they are scored).
SAMPLE_CHARS = 60_000
BITS = 16
#: Steps of the fit, at least.
STEPS = 320
REAL, RESIDUE, NOTICE, FILLER = range(4)
KINDS = ("real", "residue", "notice", "filler")

# Notations of placeholders.
PLACEHOLDER = re.compile(
    r"\{%[^%{}]*%\}(?:\{\{[^{}]*\}\}\{%[^%{}]*%\})?|\{\{[^{}]*\}\}|<%[^%<>]*%>|%%\w+%%|%[A-Z_]{3,}%|\$\{[^{}\s]*\}|\{\$\w+\}|#\{\w+\}|@@\w+@@"
    r"|\{\d\}|__[A-Z]{3,}__|X{3,}-\w+-X{3,}|\[(?:insert|your|enter|add|name|title|author|date|summary)\b[^\]\n]{0,40}\](?!\()|\[object Object\]"
    r"|«[^«»]{0,40}(?:einfügen|eintragen|insérer|à compléter)»|【此处[^】]{0,20}】|（待[^）]{0,20}）|\(待[^)]{0,20}\)|<(?:name|titel|nom|titre|your|insert)\b[^<>\n]{0,40}>",
    re.I,
)
BARE = re.compile(r"\b(?:undefined|null|NaN)\b")
# Response statuses.
STATUS = re.compile(
    r"^(?:(?:http(?:/[\d.]+)?|error|fehler|erreur|status|错误)[ :：]*)?[45]\d\d(?:\b|[:：])|^\{\"(?:code|status|error|errcode)\":|bad gateway|forbidden|internal server error|service unavailable"
    r"|^(?:oops|sorry|hoppla|désolé)\b|^(?:抱歉|出错了|系统提示)|^connection problem|^fatal:|^at \w+ \(/|^traceback",
    re.I,
)
# Demands for scripts.
SCRIPTS = re.compile(
    r"(?:javascript|\bjs\b|scripts?\b|skripte?\b|脚本).{0,30}(?:enable|turn on|switched off|blocked|needs?|required?|disabled|activ|aktiv|blockiert|bloqu|désactiv|unterstützt|abgeschaltet|ausgeschaltet|benötigt|erforderlich|nécessaire|requis|开启|启用|不支持|未启用|运行)"
    r"|(?:enable|turn on|needs?|requires?|does not run|activate|aktivieren|activer|activez|braucht|benötigt|erfordert|keine|nécessite|requiert|besoin de|pas (?:de|les)|开启|启用|打开|不支持|未启用|需要运行|运行).{0,12}(?:javascript|\bjs\b|scripts?\b|skripte?\b|脚本)",
    re.I,
)
# Words of the common filler text, and phrases of filler.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor tempora incididunt labore magna aliqua aliquam quis quisque nulla varius vitae ornare sagit lectus mollis semper porta pulvinar fermen tellus libero augue cursus dictum".split())
FILLER_PHRASE = re.compile(r"(?:(.{2,24}?)[\s.,;。，]{0,2})(?:\1[\s.,;。，]{0,2}){2,}", re.S)

# Phrases that label by themselves.
SCRIPT_PHRASES = (
    "Please enable JavaScript to view this page.", "This app needs JavaScript.", "JavaScript is switched off in your browser.",
    "Your browser does not run scripts.", "Bitte aktivieren Sie JavaScript, um die Seite zu sehen.", "Skripte sind blockiert.",
    "Diese Anwendung braucht JavaScript.", "JavaScript ist abgeschaltet.", "Ihr Browser führt keine Skripte aus.", "Diese Seite benötigt JavaScript, damit der Text geladen werden kann.",
    "Cette application nécessite JavaScript.", "JavaScript est désactivé dans votre navigateur.", "Votre navigateur n'exécute pas les scripts.", "Cette page a besoin de JavaScript pour être affichée.",
    "Veuillez activer JavaScript pour lire la suite.", "Les scripts sont bloqués.", "请开启 JavaScript 后继续浏览。", "当前浏览器未启用脚本。", "您的浏览器不支持 JS。",
)
FILLER_PHRASES = ("Lorem ipsum dolor sit amet.", "Text goes here. Text goes here.", "Blah blah. Blah blah.", "测试测试测试测试", "占位文本占位文本占位文本", "Blindtext Blindtext Blindtext")
NOTATIONS = ("{{title}}", "{{author|wikilink}}", "{% for tag in tags %}{{tag}}{% endfor %}", "<%= title %>", "%%TITLE%%", "%TITLE%", "${title}", "{$title}", "#{title}", "@@TITLE@@", "{0}", "__TITLE__", "[INSERT TITLE HERE]", "[Your name]", "[object Object]", "undefined")
SLOTS = ("{}", "{}.", "By {}", "Title: {}", "Hello {},", "Read more about {}", "{} – {}", "Dear {}, here is your clip.")

# Names of fields that are shown with their value.
FIELDS = "Author By Source Date Summary Tags Published Updated Category Site Section Autor Von Quelle Datum Zusammenfassung Auteur Par Résumé Publié 作者 来源 日期 摘要 标签 发布于".split()

# Sentences with unfilled slots, sentences that speak of placeholders, and words of the latter.
LONG_SLOTS = (
    "This article was written by {} and published on {} in the weekly edition of {}.", "Published on {} by {}, updated on {} by our editorial team.", "Thank you for subscribing to {}; your next issue arrives on {}.",
    "You are reading {} on {}, the magazine for curious readers.", "Hello {}, your clip of {} has been saved to your library.", "All rights reserved by {}; republished here with the permission of {}.",
    "Continue reading {} and many other stories by {} in our archive.", "We talked to {} about the new edition and what comes next.", "{} lives in {} and has worked for {} since {}.",
    "Dieser Artikel wurde von {} geschrieben und am {} veröffentlicht.", "Veröffentlicht am {} von {} in der Rubrik {}, zuletzt geändert am {}.", "Hallo {}, der Beitrag {} wurde in deiner Bibliothek gespeichert.",
    "Cet article a été écrit par {} et publié le {} dans la rubrique {}.", "Publié le {} par {}, mis à jour le {} par la rédaction.", "Bonjour {}, la page {} a été enregistrée dans votre bibliothèque.",
    "本文由{}撰写，于{}发表在{}栏目。", "发布于{}，作者{}，更新时间{}，来源{}。", "感谢{}对本站的支持，欢迎继续阅读{}的其他文章。", "您好，{}，您收藏的{}已经保存到资料库。",
)
MENTIONS = (
    "In the template, {} is replaced by the name of the page.", "Write {} if you want plain text instead of a link.", "We put {} in quotes because the parser expected that form.", "The script prints {} when a value is nested.",
    "{} is the variable for the name of the author.", "Use {} in your template to insert the date.", "The old engine left {} in the output when a field was empty.", "If you see {} in a note, the variable was not resolved.", "The syntax {} comes from an older template language.",
    "Under these rules the contract is {} and void.", "This is {} behaviour of the compiler.", "The function returns {} when nothing was found.",
    "In der Vorlage wird {} durch den Titel ersetzt.", "Schreibe {}, wenn du den Link brauchst.", "Die Variable {} steht für den Namen des Autors.", "Dans le modèle, {} est remplacé par le nom.", "La variable {} contient le nom de l'auteur.", "Écrivez {} si vous voulez un lien.",
    "模板里写{}就会换成名字。", "变量{}表示作者的名字。", "在模板中，{}会被替换成日期。", "如果看到{}，说明变量没有被替换。",
)
MENTION = re.compile(r"templates?\b|\bvariables?\b|placeholder|syntax|\bwrite\b|replaced|\bprints?\b|\bquotes\b|\bengine\b|\bparser\b|\bvoid\b|behaviou?r|\breturns?\b|vorlage|platzhalter|ersetzt|schreib(?:e|t)?\b|modèle|remplacé|écri(?:re|vez)\b|模板|变量|占位符|替换|换成", re.I)

BLOCK = re.compile(r"<([A-Za-z][A-Za-z0-9]*)\b[^>]*?\bdata-b\s*=\s*[\"']?\d+[\"']?[^>]*>(.*?)(?=</\1\s*>|<(?!/?(?:b|i|em|a|br|code|strong|span|sub|sup|mark|u|s|small|img)\b)[A-Za-z/!]|\Z)", re.S | re.I)
TAG = re.compile(r"<[A-Za-z/!][^>]*>")
LEADING_LINK = re.compile(r"\s*<a\b", re.I)


@dataclass(frozen=True)
class Segment:
    text: str
    place: str  # heading, code, meta, list, link or text
    titled: int  # 2: it is the title; 1: it holds the title or is held by it; 0
    title: str = ""  # without case and accents, where titled is 1


def _plain(text: str) -> str:
    """Without case and accents."""
    text = text.casefold()
    return text if text.isascii() else "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))


def _segment(text: str, place: str, title: str) -> Segment:
    related = _relation(text, title)
    return Segment(text, place, related, title if related == 1 else "")


def _relation(text: str, title: str) -> int:
    """``title`` comes without case and accents."""
    if not title or 2 * len(text) < len(title):  # plain text may be longer: ß is ss
        return 0
    text = _plain(text) if len(text) <= 4 * len(title) + 40 else ""
    return 2 if text == title else int(len(title) > 5 and title in text)


def page_segments(markup: str | None, title: str | None) -> list[Segment]:
    """The blocks of a page. Blocks that begin with a link, and buttons, are links."""
    found, title = [], _plain(one_form(title or ""))
    for m in BLOCK.finditer(markup or ""):
        tag, inner = m[1].lower(), m[2]
        text = TAG.sub("", inner)
        text = one_form(_html.unescape(text) if "&" in text else text)
        if not text:
            continue
        if tag == "pre" or "<code" in inner:
            place = "code"
        elif tag == "button" or LEADING_LINK.match(inner):
            place = "link"
        else:
            place = "heading" if tag[0] == "h" and tag[1:].isdigit() else "text"
        found.append(_segment(text, place, title))
    return found


def note_segments(markdown: str | None, title: str | None) -> list[Segment]:
    """The lines of a note, with its front matter."""
    found, title = [], _plain(one_form(title or ""))
    lines = (markdown or "").split("\n")
    meta, fence = bool(lines) and lines[0].strip() == "---", False
    for i, line in enumerate(lines):
        if meta:
            if i and line.strip() == "---":
                meta = False
            elif i and ":" in line:
                key, _, value = line.partition(":")
                value = one_form(value).strip("\"'")
                if value and key.strip() != "tags":
                    found.append(_segment(value, "meta", title))
            continue
        if line.lstrip().startswith("```"):
            fence = not fence
            continue
        text = one_form(line)
        if not text:
            continue
        place = "code" if fence else "text"
        if place == "text" and text[0] in "#>-*+":
            mark = re.match(r"(#+|>|[-*+](?: \[[ x]\])?) +", text)
            if mark:
                place, text = ("heading" if text[0] == "#" else "list" if text[0] in "-*+" else "text"), text[mark.end() :]
        found.append(_segment(text, place, title))
    return found


def _weight(text: str) -> int:
    """Letters, an ideograph counting as three."""
    return sum(3 if ch >= "⺀" else 1 for ch in text if ch.isalnum())


def slot_shaped(seg: Segment) -> bool:
    """A placeholder with at most a label around it."""
    if seg.place == "code" or seg.titled:
        return False
    rest, n = PLACEHOLDER.subn("", seg.text)
    if not n:
        rest, n = BARE.subn("", seg.text)
        return n > 0 and _weight(rest) <= 22 and not re.search(r"[{}();]", rest)
    return _weight(rest) <= 24


#: Ends of sentences, within no placeholder.
_STOP = re.compile(r"[.!?…](?=[\"'”’»)\]]*\s)|[。！？\n]")


def slots(seg: Segment) -> list[Segment]:
    """The sentence around each placeholder of a segment: without the record's
    title, and not those placeholders that are the title's own."""
    if seg.place == "code" or seg.titled == 2:
        return []
    text = seg.text
    if seg.title and len(low := _plain(text)) == len(text):
        at = low.find(seg.title)
        text = text[:at] + " " + text[at + len(seg.title) :] if at >= 0 else text
    marks = list(PLACEHOLDER.finditer(text))
    if not marks and not told(text) and not re.search(r"[{}();]", text):  # values in code and messages
        marks = list(BARE.finditer(text))
    marks = [m for m in marks if not (seg.title and _plain(m[0]) in seg.title)]
    if not marks:
        return []
    inside = lambda i: any(m.start() <= i < m.end() for m in marks)
    edges = [0, *(m.end() for m in _STOP.finditer(text) if not inside(m.start())), len(text)]
    sentences = [(a, b) for a, b in zip(edges, edges[1:]) if any(a <= m.start() < b for m in marks)]
    return [Segment(t, "slot", 0) for a, b in sentences if (t := text[a:b].strip())]


def is_filler(text: str) -> bool:
    words = re.findall(r"[a-z]+", text.lower())
    if len(words) >= 5 and sum(w in LATIN for w in words) >= 0.6 * len(words):
        return True
    m = FILLER_PHRASE.match(text)
    return bool(m) and m.end() >= 0.9 * len(text) and len(text) >= 12


def told(text: str) -> bool:
    """Whether a short text has a status or demands scripts."""
    if len(text) > 240:
        return False
    low = text.lower()
    return bool(STATUS.search(text)) or any(w in low for w in ("script", "skript", "js", "脚本")) and bool(SCRIPTS.search(text))


def slot_label(seg: Segment) -> int | None:
    """What the words around a placeholder suggest."""
    return RESIDUE if slot_shaped(seg) else REAL if MENTION.search(seg.text) else None


def emptied(text: str, seed: int, mark: str) -> str | None:
    """A sentence of a real text with ``mark`` instead of one of its words."""
    sentence = max(_STOP.split(text), key=len).strip()[:400]
    words = list(re.finditer(r"[^\W\d_\u2e80-\uffff]{2,}|[\u4e00-\u9fff]{2}", sentence))
    if len(words) < 4 or MENTION.search(sentence):
        return None
    m = words[seed % len(words)]
    return sentence[: m.start()] + mark + sentence[m.end() :]


def weak_labels(segments: Sequence[Segment]) -> list[tuple[int | None, bool]]:
    """The kinds that statuses, phrases and shapes suggest, None where they say
    nothing, and whether the segment is one of the telling ones."""
    main = [s for s in segments if s.place not in ("meta", "code", "link")]
    says = {id(s): told(s.text) for s in main}
    weights = {id(s): _weight(s.text) for s in main}
    titled = any(s.titled == 2 and s.place == "heading" for s in main)
    replaced = (
        any(says.values()) and not titled and sum(weights.values()) <= 420 and not any(w > 170 for w in weights.values())
    )
    labels: list[tuple[int | None, bool]] = []
    for s in segments:
        if s.place == "link":
            labels.append((None, False))
            continue
        marked = bool(PLACEHOLDER.search(s.text) or BARE.search(s.text))
        if marked and slot_shaped(s):
            labels.append((RESIDUE, True))
        elif marked and any(slot_label(x) != REAL for x in slots(s)):
            labels.append((None, True))  # an unfilled slot, perhaps
        elif s.place in ("code", "meta"):
            labels.append((REAL, marked))
        elif is_filler(s.text):
            labels.append((FILLER, True))
        elif replaced and weights[id(s)] <= 150:
            labels.append((NOTICE, True))
        elif says[id(s)] and weights[id(s)] <= 80 and (not titled or SCRIPTS.search(s.text)):
            labels.append((None, True))  # a notice beside the text, perhaps
        else:
            labels.append((REAL, marked or says[id(s)]))
    return labels


# features --------------------------------------------------------------------


HEX, DIGITS = re.compile(r"[0-9a-f]{8,}"), str.maketrans("123456789", "0" * 9)


def features(segments: Sequence[Segment]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, segment numbers and values of the hashed features of all segments at once."""
    # around a placeholder the words count, not its notation, and apart from those of whole segments
    texts = [HEX.sub("#", PLACEHOLDER.sub("◆", s.text) if s.place == "slot" else s.text).translate(DIGITS).lower() for s in segments]
    apart = np.array([0x51ED270B if s.place == "slot" else 0 for s in segments] + [0], dtype=np.uint64)
    flat = np.frombuffer("\0".join(["", *(f"\x01{t}\x02" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(flat == 0) - 1
    index, number = [], []
    for n in (2, 3, 4):
        if len(flat) <= n:
            continue
        code = np.uint64(0x9E3779B97F4A7C15 + n) ^ apart[owner[: len(flat) - n + 1]]
        inside = np.ones(len(code), dtype=bool)
        for k in range(n):
            part = flat[k : k + len(code)]
            code = (code ^ part) * np.uint64(0x100000001B3)
            code ^= code >> np.uint64(29)
            inside &= part != 0
        index.append(((code[inside] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64))
        number.append(owner[: len(code)][inside])
    idx, seg = np.concatenate(index), np.concatenate(number)
    counts = np.bincount(seg, minlength=len(segments)).astype(np.float64)
    val = (1.0 / np.sqrt(np.maximum(counts, 1.0)))[seg]
    extra = np.array([[hash_of("len", min(12, max(1, _weight_fast(s.text)).bit_length())), hash_of("place", s.place), hash_of("title", s.titled)] for s in segments], dtype=np.int64).reshape(-1)
    idx = np.concatenate([idx, extra])
    seg = np.concatenate([seg, np.repeat(np.arange(len(segments)), 3)])
    return idx, seg, np.concatenate([val, np.full(len(extra), 0.7)])


def _weight_fast(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def hash_of(*key) -> int:
    h = 2166136261
    for ch in repr(key):
        h = ((h ^ ord(ch)) * 16777619) & 0xFFFFFFFF
    return h >> (32 - BITS)


@dataclass
class Model:
    weights: np.ndarray  # kinds x features
    bias: np.ndarray
    #: The least probability of each kind but real text.
    least: tuple[float, ...] = (0.0, 0.5, 0.5, 0.5)

    def kinds(self, segments: Sequence[Segment]) -> np.ndarray:
        """The likeliest kind that is likely enough, else real text."""
        p = self.scores(segments)
        p[:, 1:][p[:, 1:] < np.array(self.least[1:])] = -1.0
        return p.argmax(axis=1)

    def scores(self, segments: Sequence[Segment]) -> np.ndarray:
        """Probabilities, segments x kinds."""
        if not segments:
            return np.zeros((0, len(KINDS)))
        idx, seg, val = features(segments)
        raw = np.stack([np.bincount(seg, self.weights[k][idx] * val, minlength=len(segments)) for k in range(len(KINDS))], axis=1) + self.bias
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def fit(segments: Sequence[Segment], labels: Sequence[int], steps: int = STEPS, batch: int = 192, rate: float = 0.6, decay: float = 1e-5, seed: int = 7) -> Model:
    """Softmax regression by Adagrad with weight decay; kinds weigh equally."""
    weights, bias = np.zeros((len(KINDS), 1 << BITS)), np.zeros(len(KINDS))
    y = np.asarray(labels)
    if not len(y):
        return Model(weights.astype(np.float32), bias)
    share = np.sqrt(len(y) / (len(KINDS) * np.maximum(np.bincount(y, minlength=len(KINDS)), 1)))
    grown, order = np.full_like(weights, 1e-8), np.random.default_rng(seed)
    for _ in range(max(3, -(-steps * batch // len(y)))):
        turn = order.permutation(len(y))
        for at in range(0, len(turn), batch):
            pick = turn[at : at + batch]
            idx, seg, val = features([segments[i] for i in pick])
            used, place = np.unique(idx, return_inverse=True)
            w = weights[:, used]
            raw = np.stack([np.bincount(seg, w[k][place] * val, minlength=len(pick)) for k in range(len(KINDS))], axis=1) + bias
            raw = np.exp(raw - raw.max(axis=1, keepdims=True))
            off = raw / raw.sum(axis=1, keepdims=True)
            off[np.arange(len(pick)), y[pick]] -= 1.0
            off *= share[y[pick]][:, None] / len(pick)
            for k in range(len(KINDS)):
                g = np.bincount(place, off[seg, k] * val, minlength=len(used)) + decay * w[k]
                grown[k, used] += g * g
                weights[k, used] -= rate * g / np.sqrt(grown[k, used])
            bias -= 0.5 * off.sum(axis=0)
    return Model(weights.astype(np.float32), bias)


# decisions -------------------------------------------------------------------


def judged(model: Model, records: Sequence[Sequence[Segment]]) -> list[np.ndarray]:
    """The kind of each segment of each record; links and code count as real.
    Residue is told by the sentences around the placeholders."""
    flat = [s for segments in records for s in segments if s.place not in ("link", "code")]
    around = [slots(s) if PLACEHOLDER.search(s.text) or BARE.search(s.text) else [] for s in flat]
    best = model.kinds(flat)
    slot = iter((model.kinds([x for own in around for x in own]) == RESIDUE).tolist())
    unfilled = [any([next(slot) for _ in own]) for own in around]
    at, kinds = 0, []
    for segments in records:
        own = np.zeros(len(segments), dtype=int)
        for i, s in enumerate(segments):
            if s.place not in ("link", "code"):
                own[i] = RESIDUE if unfilled[at] else REAL if best[at] == RESIDUE else best[at]
                at += 1
        kinds.append(own)
    return kinds


def replaced(segments: Sequence[Segment], kinds: Sequence[int], page: bool) -> bool:
    """Whether notices or filler stand where the content belonged."""
    main = [(s, k) for s, k in zip(segments, kinds) if s.place not in ("meta", "code", "link")]
    odd = sum(_weight(s.text) for s, k in main if k in (NOTICE, FILLER))
    if not odd:
        return False
    if page:
        if any(s.titled == 2 and s.place == "heading" for s, _ in main):
            return False
        return odd >= sum(w for s, k in main if k == REAL and (w := _weight(s.text)) >= 100)
    if any(s.place == "code" for s in segments):
        return False
    return not any(k == REAL and (s.place == "list" or _weight(s.text) >= 20) for s, k in main if s.place != "heading")


def is_case(segments: Sequence[Segment], kinds: Sequence[int], page: bool) -> bool:
    return any(k == RESIDUE for k in kinds) or replaced(segments, kinds, page)


def _segments(kind: str, text: str | None, title: str | None) -> list[Segment]:
    return page_segments(text, title) if kind == "page" else note_segments(text, title)


def _text(v) -> str | None:
    return v if isinstance(v, str) else None


def sample(records: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """At most about ``bound`` records, chosen by a hash of their keys."""
    n = records.count()
    share = min(1.0, bound / max(1, n))
    pick = F.pmod(F.xxhash64(F.lit(17), "rec_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    return records.where(pick & (F.length("text") <= SAMPLE_CHARS))


def labelled(records: DataFrame) -> DataFrame:
    """Weakly labelled segments of ``records`` (``rec_id, host, kind, title, text``),
    real ones that tell nothing thinned to one in eight by a hash."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec, kind, host, title, text in zip(b["rec_id"], b["kind"], b["host"], b["title"], b["text"]):
                segments = _segments(kind, _text(text), _text(title))
                for i, (s, (label, tells)) in enumerate(zip(segments, weak_labels(segments))):
                    if label is not None and (label != REAL or tells or hash_of(rec, i) % 8 == 0):
                        rows.append((_text(host) or "", s.text, s.place, s.titled, label))
                    if s.place != "link" and (PLACEHOLDER.search(s.text) or BARE.search(s.text)):
                        rows += [(_text(host) or "", x.text, x.place, x.titled, k) for x in slots(s) if (k := slot_label(x)) is not None]
            yield pd.DataFrame(rows, columns=["host", "segment", "place", "titled", "label"])

    return records.select("rec_id", "kind", "host", "title", "text").mapInPandas(parts, "host string, segment string, place string, titled int, label int")


def phrases() -> tuple[list[Segment], list[int]]:
    """Segments that statuses and phrases label, whatever the tables hold."""
    statuses = [f for s in HTTPStatus if s >= 400 for f in (f"{s.value} {s.phrase}", f"Error {s.value}", f"HTTP {s.value}: {s.phrase}")]
    words, draw = sorted(LATIN), np.random.default_rng(3)
    latin = [" ".join(draw.choice(words, int(draw.integers(4, 30)))).capitalize() + "." for _ in range(60)]
    told = {NOTICE: [*statuses, *SCRIPT_PHRASES], FILLER: [*FILLER_PHRASES, *latin], RESIDUE: [slot.replace("{}", n) for n in NOTATIONS for slot in SLOTS]}
    pairs = [(Segment(one_form(t), place, 0), k) for k, texts in told.items() for t in texts for place in ("text", "heading", *["meta"] * (k == RESIDUE))]
    around = [(Segment(one_form(t.replace("{}", n)), "slot", 0), k) for k, texts in ((RESIDUE, (*SLOTS, *LONG_SLOTS)), (REAL, MENTIONS)) for n in (NOTATIONS[0], "undefined", "null", "NaN") for t in texts] * 4
    pairs += around
    pairs += [(Segment(one_form(t.format(f, w)), "slot", 0), RESIDUE) for f in FIELDS for w in ("undefined", "null", "NaN") for t in ("{0}: {1}", "{0} {1}", "{0}：{1}", "{0}: {1} / {1}", "{1}")]
    return [s for s, _ in pairs], [k for _, k in pairs]


def gathered(records: Sequence[DataFrame], bound: int) -> list:
    """The labelled segments of samples of the tables. Texts that stand in real
    records more often than in replaced ones (a site's footer, say) are real."""
    rows = [r for df in records for r in labelled(sample(df, bound)).collect()]
    rows.sort(key=lambda r: (r.segment, r.place, r.titled, r.label, r.host))
    plain = [HEX.sub("#", r.segment).translate(DIGITS).replace(r.host.split(".")[0] or "\0", "@") for r in rows]
    real = Counter(t for t, r in zip(plain, rows) if r.label == REAL)
    odd = Counter(t for t, r in zip(plain, rows) if r.label == NOTICE)
    return [(r, REAL if r.label == NOTICE and 8 * real[t] > odd[t] else r.label) for t, r in zip(plain, rows)]


def _unseen(key: str, part: int = 4) -> bool:
    return hash_of("host", key) % part == 0


def _examples(rows: list) -> tuple[list[Segment], list[int], np.ndarray]:
    """Segments with their labels, and which are kept back: those of every
    fourth host, and every fourth phrase in all its places."""
    segments, labels = phrases()
    apart = [_unseen(s.text) for s in segments]
    for r, label in rows:
        seed, own = hash_of(r.segment), _unseen(r.host)
        segments.append(Segment(r.segment, r.place, r.titled))
        labels.append(label)
        apart.append(own)
        if label == REAL and r.place == "text" and seed % 2 and not (PLACEHOLDER.search(r.segment) or BARE.search(r.segment)) and emptied(r.segment, 0, ""):
            # within prose, null and the like are words
            for mark, k in (("{{title}}", RESIDUE), (("undefined", "null", "NaN")[seed % 3], REAL)):
                segments.append(Segment(emptied(r.segment, seed, mark), "slot", 0))
                labels.append(k)
                apart.append(own)
    return segments, labels, np.array(apart, dtype=bool)


def least_likely(p: np.ndarray, labels: np.ndarray, kind: int) -> float:
    """The probability from which on segments are of a kind: the best by the
    F measure on labelled ones, the middle of the best range; a half where none has the kind."""
    true = labels == kind
    if not true.any():
        return 0.5
    steps = np.linspace(0.2, 0.9, 71)
    score = np.array([2 * ((p >= t) & true).sum() / max(1, (p >= t).sum() + true.sum()) for t in steps])
    best = np.flatnonzero(score >= score.max() - 1e-12)
    # of the runs of best steps that nearest to a half
    run = min(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=lambda r: int(np.abs(r - 30).min()))
    return 0.5 if run[0] <= 30 <= run[-1] else float(steps[run].mean())


def _fitted(rows: list) -> Model:
    return _fitted_on(*_examples(rows))


def _fitted_on(segments: Sequence[Segment], labels: Sequence[int], apart: np.ndarray, whole: bool = True) -> Model:
    """With the probabilities that suit the examples kept back from a first fit; ``whole``: then fitted on all."""
    y, seen, unseen = np.array(labels), np.flatnonzero(~apart), np.flatnonzero(apart)
    model = fit([segments[i] for i in seen], y[seen], steps=STEPS // 2 if whole else STEPS)
    p = model.scores([segments[i] for i in unseen])
    around = np.array([segments[i].place == "slot" for i in unseen], dtype=bool)
    least = (0.0, least_likely(p[around, RESIDUE], y[unseen][around], RESIDUE), *(least_likely(p[~around, k], y[unseen][~around], k) for k in (NOTICE, FILLER)))
    model = fit(segments, y) if whole else model
    model.least = least
    return model


def learn(records: Sequence[DataFrame], bound: int = SAMPLE) -> Model:
    """The classifier, fitted on samples of the tables."""
    return _fitted(gathered(records, bound))


def _scored(records: DataFrame, model: Model, columns: Sequence[str], wanted: bool) -> DataFrame:
    """The columns of those records that are cases, or of those that aren't."""
    shared = records.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.least))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = Model(*shared.value)
        for b in batches:
            each = [_segments(kind, _text(text), _text(title)) for kind, title, text in zip(b["kind"], b["title"], b["text"])]
            kinds = judged(here, each)
            hit = [is_case(segments, own, kind == "page") == wanted for kind, segments, own in zip(b["kind"], each, kinds)]
            yield b.loc[np.array(hit, dtype=bool), list(columns)]

    types = dict(records.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns)
    return records.select("src_table", "rec_id", "kind", "title", "text").where(F.col("text").isNotNull()).mapInPandas(score, schema)


def cases(records: DataFrame, model: Model) -> DataFrame:
    """The keys of the records (``src_table, rec_id, kind, title, text``) that are cases."""
    return _scored(records, model, ("src_table", "rec_id"), True).distinct()


def kept(records: DataFrame, model: Model) -> DataFrame:
    """The records with a text that are no cases: ``src_table, rec_id, title,
    text``, every delivery, in one pass and without moving texts."""
    return _scored(records, model, ("src_table", "rec_id", "title", "text"), False)


def validate(records: Sequence[DataFrame], bound: int = SAMPLE) -> dict[str, float]:
    """Agreement with the weak labels on hosts and phrases the classifier hasn't seen."""
    segments, labels, apart = _examples(gathered(records, bound))
    model = _fitted_on(segments, labels, apart, whole=False)
    test = [s for s, a in zip(segments, apart) if a]
    guess, label = model.kinds(test), np.array(labels)[apart]
    found = {"n_train": float((~apart).sum()), "n_test": float(apart.sum()), "accuracy": float((guess == label).mean())}
    for k, name in enumerate(KINDS):
        found[f"recall_{name}"] = float((guess[label == k] == k).mean()) if (label == k).any() else 1.0
        found[f"precision_{name}"] = float((label[guess == k] == k).mean()) if (guess == k).any() else 1.0
    return found
