"""Free-entered names mapped to the entries of a reference list; names that mean no entry are reported.

Per distinct value, never per row: the value is folded (see fold), stripped of list marks and notes, and cut into
tokens. Each distinct token is joined to the vocabulary of the reference list by edit distance: a deletion
neighbourhood of the vocabulary, looked up by hash, gives the candidates within one or two edits, so no token meets
the whole vocabulary; tokens glued together or cut apart are repaired by segmentation. Abbreviations join by prefix or
as a subsequence with the same first letter, among the words that an index by first and second letter gives. A Han
character that the vocabulary doesn't hold is repaired by the pairs it forms with its neighbours: vocabulary pairs that
differ from them in that character. The corrected tokens of a value then rank the complete entries by soft
TF-IDF: a token of an entry counts with its weight times the likeness of the value's token that repairs to it. Han
names, written without blanks, take their characters as tokens. The likeness of the whole strings (edit distance with
transpositions) settles what the bag of tokens can't, and the best entry is taken if it is like enough and leads the
next one; else the value means NONE.

Defined results: null maps to null; empty, blank and mark-only values mean NONE; exact term names map to themselves;
two entries with the same score and name are told apart by the smaller id.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from veriloom.llm.fold import fold, words_of

NONE = "NONE"
# Traditional characters of the words in the reference lists, with their simplified forms.
TRADITIONAL = dict(zip(
    "銀農業財產險壽養資瑞壟啟興遠嶼瀾霧鷺雲風龍東門車輛傷醫療總額費應償賠規權暴露單點貸綠產續滿準備傭務內趨勢體結淨餘動綜網業證員銷戶數貨幣機構長時間會議處報關億萬與個號歲進裡麥穀貝見黃園區島縣灣臨過獲收規礎團術據圖場樂樹橋確禮線縮織聯節脫覆觀計訂訪設試該認語課調談論講識譯護讀變",
    "银农业财产险寿养资瑞垄启兴远屿澜雾鹭云风龙东门车辆伤医疗总额费应偿赔规权暴露单点贷绿产续满准备佣务内趋势体结净余动综网业证员销户数货币机构长时间会议处报关亿万与个号岁进里麦谷贝见黄园区岛县湾临过获收规础团术据图场乐树桥确礼线缩织联节脱覆观计订访设试该认语课调谈论讲识译护读变",
))
# Marks before and after a name that belong to the table, not to the name.
_LEAD = re.compile(
    r"^(?:[\s*#•·>+_–—-]+|of\s*which\s*[:,]?|o/+w\b[:,]?|thereof\s*[:,]?|incl\.?\s|其中[:,]?|"
    r"\(?[0-9]{1,2}\s*[.)、](?![0-9])|\(\s*(?:[a-z]|[ivx]{1,4}|[一二三四五六七八九十]{1,3}|[0-9]{1,2})\s*\)|[一二三四五六七八九十]{1,2}\s*、)\s*"
)
_TAIL = re.compile(r"(?:[\s*:：#†‡.,;_]+|\[\s*[0-9]+\s*\]|(?<![0-9])[0-9]\s*\)|[(]\s*(?:注\s*[0-9]*|p|r|e|ytd|本期|累计|上期|city|group|集团)\s*[)]|[-–—]+\s*note\s*[0-9]+)$")
#: Words that say what kind of body or line it is and tell no entry from another.
FILLERS = {
    "ltd", "co", "plc", "inc", "corp", "holdings", "group", "the", "limited", "company", "branch", "region", "prov", "province", "city", "area", "of", "and", "which", "ow", "note", "ytd", "p", "total",
    "有限公司", "股份有限公司", "股份公司", "公司", "总部", "集团", "分公司", "市", "省", "地区", "辖区", "小计", "项目", "合计", "本期", "累计", "注", "其中",
}
_HANRUN = re.compile(r"[㐀-鿿]")
#: Repairs that a worker keeps; beyond that it starts anew.
_KEPT = 200_000


@dataclass(frozen=True)
class Bounds:
    """accept: least score of an entry; lead: least lead over the next entry where the score is below `clear`."""

    accept: float = 0.5
    lead: float = 0.0
    clear: float = 0.8


def strip_marks(text: str) -> str:
    """Text without list marks before it and note marks after it."""
    while True:
        cut = _TAIL.sub("", _LEAD.sub("", text, count=1).strip(), count=1).strip()
        if cut == text:
            return text
        text = cut


def deaccent(text: str) -> str:
    """Letters without their accents."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))).replace("ł", "l").replace("ø", "o")


def distance(a: str, b: str, most: int = 99) -> int:
    """Edit distance with transpositions of neighbours (optimal string alignment); more than `most` gives most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most and min(last) > most:  # a transposition reaches two rows back
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


def likeness(a: str, b: str) -> float:
    """1 less the edit distance over the longer length."""
    n = max(len(a), len(b))
    return 1 - distance(a, b) / n if n else 1.0


def _deletions(word: str, edits: int) -> set[str]:
    out, edge = {word}, {word}
    for _ in range(edits):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        out |= edge
    return out


def _most(cheap: float, factor: float) -> float:
    """The most that a score can become once the whole strings are compared."""
    return ((cheap + 0.35) * 0.94 + 0.06) * factor


def _within(short: str, long: str) -> bool:
    """True if short is long less some of its characters."""
    it = iter(long)
    return len(short) < len(long) and all(c in it for c in short)


@dataclass
class Entry:
    term_id: str
    name: str
    forms: list[str] = field(default_factory=list)


class Kind:
    """The reference list of one kind, with its vocabulary and indexes."""

    def __init__(self, entries: list[Entry], vocabulary: frozenset[str], bounds: Bounds = Bounds()):
        self.bounds, self.vocabulary = bounds, vocabulary
        self.exact: dict[str, str] = {}
        self.forms: list[tuple[str, str, list[str]]] = []
        for e in sorted(entries, key=lambda e: e.term_id):
            self.exact.setdefault(e.name, e.term_id)
        for e in sorted(entries, key=lambda e: e.term_id):
            for k, f in enumerate([e.name, *e.forms]):
                text = self.clean(f)
                if text:
                    self.forms.append((e.term_id, text, self.tokens(text)))
        #: Folded forms, to settle values that differ in case, marks or characters only.
        self.folded: dict[str, set[str]] = {}
        for t, text, _ in self.forms:
            self.folded.setdefault(self.squeeze(text), set()).add(t)
        df = Counter(tok for _, _, toks in self.forms for tok in set(toks))
        n = len(self.forms)
        self.idf = {tok: math.log(1 + n / c) for tok, c in df.items()}
        self.words = sorted(w for w in df if not _HANRUN.match(w))
        #: Words by first letter and a later one, where an abbreviation looks for what it may stand for.
        self.starts: dict[tuple[str, str], list[str]] = {}
        for w in self.words:
            for x in set(w[1:]):
                self.starts.setdefault((w[0], x), []).append(w)
        #: Han characters by the neighbour before (1) and after (-1) them: the pairs of the vocabulary, one character open.
        self.beside: dict[tuple[int, str], set[str]] = {}
        for _, _, toks in self.forms:
            for a, b in zip(toks, toks[1:]):
                if _HANRUN.match(a) and _HANRUN.match(b):
                    self.beside.setdefault((1, a), set()).add(b)
                    self.beside.setdefault((-1, b), set()).add(a)
        self.near: dict[str, list[str]] = {}
        for w in self.words:
            for x in _deletions(w, 2 if len(w) > 4 else 1):
                self.near.setdefault(x, []).append(w)
        self.post: dict[str, list[int]] = {}
        for i, (_, _, toks) in enumerate(self.forms):
            for tok in set(toks):
                self.post.setdefault(tok, []).append(i)
        self.prepared = [(t, self.squeeze(f), Counter(toks), sum(self.idf[w] for w in toks), self.squeeze("".join(sorted(toks)))) for t, f, toks in self.forms]
        self.repaired: dict[str, dict[str, float]] = {}

    def clean(self, value: str) -> str:
        text = fold(value, self.vocabulary) or ""
        text = strip_marks(text)
        return "".join(TRADITIONAL.get(c, c) for c in deaccent(text))

    @staticmethod
    def squeeze(text: str) -> str:
        return re.sub(r"[\W_]+", "", text)

    def tokens(self, text: str) -> list[str]:
        """Words of letters and digits; each Han character by itself."""
        out = []
        for w in re.findall(r"[^\W_]+", text):
            if _HANRUN.search(w):
                out += re.findall(r"[㐀-鿿]|[^\W_㐀-鿿]+", w)
            else:
                out.append(w)
        return out

    def repair(self, token: str) -> dict[str, float]:
        """The vocabulary words that a token may stand for, with their likeness; kept per distinct token."""
        known = self.repaired.get(token)
        if known is None:
            if len(self.repaired) >= _KEPT:
                self.repaired.clear()
            known = self.repaired[token] = self._repair(token)
        return known

    def repair_beside(self, before: str, token: str, after: str) -> dict[str, float]:
        """The same for a Han character that the vocabulary doesn't hold, whose pairs with its neighbours are joined to
        the pairs of the vocabulary by one exchange: a character that both pairs allow, or one of them."""
        known = self.repair(token)
        if known or not _HANRUN.match(token):
            return known
        left, right = self.beside.get((1, before), set()), self.beside.get((-1, after), set())
        return {w: 0.75 if w in left and w in right else 0.4 for w in left | right}

    def _repair(self, token: str) -> dict[str, float]:
        if token in self.idf:
            return {token: 1.0}
        if _HANRUN.match(token):
            return {}
        out: dict[str, float] = {}
        if len(token) > 2:
            for x in _deletions(token, 2 if len(token) > 4 else 1):
                for w in self.near.get(x, ()):
                    d = distance(token, w, 2)
                    if d <= (1 if len(w) <= 4 else 2):
                        out[w] = max(out.get(w, 0), 1 - d / (max(len(w), len(token)) + 1))
        for w in self.starts.get((token[0], token[1]), ()) if len(token) > 1 else ():
            # An abbreviation starts like its word and keeps the order of its letters.
            if len(token) < len(w) and w not in out:
                if w.startswith(token):
                    out[w] = 0.86
                else:
                    it = iter(w)
                    if all(c in it for c in token):
                        out[w] = 0.55 + 0.25 * len(token) / len(w)
        return out

    def segment(self, text: str) -> tuple[list[str], float]:
        """The tokens of a value whose words are glued together or cut apart, by the least total of edits, and the
        share of the text that they explain.

        Each stretch of the squeezed text stands for a vocabulary word within two edits of it (short words: exactly),
        or for nothing at a cost of one per character.
        """
        n = len(text)
        best: list[tuple[float, list[str], int]] = [(0.0, [], 0)] + [(math.inf, [], 0)] * n
        longest = max(map(len, self.words), default=0) + 2
        for i in range(n):
            cost, path, skipped = best[i]
            if cost == math.inf:
                continue
            if cost + 1 < best[i + 1][0]:
                best[i + 1] = (cost + 1, path, skipped + 1)
            for j in range(i + 2, min(n, i + longest) + 1):
                piece = text[i:j]
                hit = {w: s for w, s in self.repair(piece).items() if s == 1 or (abs(len(w) - len(piece)) <= 2 and len(w) > 4 and s > 0.6)}
                for w, s in hit.items():
                    c = cost + (0.2 if s == 1 else (1 - s) * (len(w) + 1) + 0.2)
                    if c < best[j][0]:
                        best[j] = (c, [*path, w], skipped)
        return best[n][1], 1 - best[n][2] / n

    def rank(self, value: str) -> list[tuple[float, str]]:
        """(score, term_id) of the entries that share a repaired token with a value, best first. Entries that can come
        neither first nor within the lead of the first may be left out."""
        text = self.clean(value)
        tight = self.squeeze(text)
        if not tight:
            return []
        hits = self.folded.get(tight)
        if hits:
            return [(1.0, t) for t in sorted(hits)]
        toks = self.tokens(text)
        han = sum(bool(_HANRUN.match(t)) for t in toks) * 2 > len(toks)
        core = self.bare(tight, han)
        views = [(toks, 1.0)]
        if not han and self.words:
            views.append(self.segment(core))
        # What the tokens say first; whole strings are compared only while they could still change who leads.
        found: list[tuple[float, float, float, str, str, str, str]] = []
        for view, told_share in views:
            links: dict[str, float] = {}
            for before, tok, after in zip(["", *view], view, [*view[1:], ""]):
                for w, s in self.repair_beside(before, tok, after).items():
                    links[w] = max(links.get(w, 0.0), s)
            count = Counter(view)
            # What the value says in known words beyond the entry counts against the entry.
            explained = {tok: max(self.repair(tok).items(), key=lambda x: x[1]) for tok in count if self.repair(tok)}
            told = sum(self.idf[w] * s * count[tok] for tok, (w, s) in explained.items())
            in_order = "" if han else self.squeeze("".join(sorted(view)))
            factor = 0.4 + 0.6 * told_share
            for i in {i for w in links for i in self.post[w]}:
                term, form, fc, total, sorted_form = self.prepared[i]
                hit = sum(self.idf[w] * links.get(w, 0.0) * (min(c, count.get(w, c)) if han else c) for w, c in fc.items())
                over = told - sum(self.idf[w] * s * count[tok] for tok, (w, s) in explained.items() if w in fc)
                cheap = 0.35 * hit / total + 0.3 * hit / (total + max(over, 0.0))
                found.append((_most(cheap, factor), cheap, factor, term, form, sorted_form, in_order))
        found.sort(key=lambda x: -x[0])
        scores: dict[str, float] = {}
        best = 0.0
        for most, cheap, factor, term, form, sorted_form, in_order in found:
            if most < best - self.bounds.lead:
                break
            whole = max(likeness(core, form), likeness(tight, form))
            if not han:
                whole = max(whole, likeness(in_order, sorted_form))
            score = cheap + 0.35 * whole
            if len(core) > 2 and _within(core, form):
                score += 0.06 * (1 - score)  # only letters are missing
            scores[term] = max(scores.get(term, 0.0), score * factor)
            best = max(best, scores[term])
        return sorted(((s, t) for t, s in scores.items()), key=lambda x: (-x[0], x[1]))

    def bare(self, tight: str, han: bool) -> str:
        """A squeezed text without filler words at its ends."""
        fillers = sorted((f for f in FILLERS if bool(_HANRUN.match(f)) == han and len(f) > (0 if han else 2)), key=len, reverse=True)
        while True:
            for f in fillers:
                if tight.endswith(f) and len(tight) - len(f) >= (2 if han else 4):
                    tight = tight[: -len(f)]
                    break
                if not han and tight.startswith(f) and len(tight) - len(f) >= 4:
                    tight = tight[len(f) :]
                    break
            else:
                return tight

    def match(self, value: str | None) -> tuple[str | None, float]:
        """(term_id or NONE, score) of a value; (None, 0) of null."""
        if value is None:
            return None, 0.0
        if value in self.exact:
            return self.exact[value], 1.0
        ranked = self.rank(value)
        if not ranked:
            return NONE, 0.0
        score, term = ranked[0]
        lead = score - ranked[1][0] if len(ranked) > 1 else 1.0
        b = self.bounds
        if score < b.accept or (score < b.clear and lead < b.lead):
            return NONE, score
        return term, score


class Matcher:
    """All kinds of a reference list."""

    def __init__(self, terms: list[tuple[str, str, str, list[str] | None]], bounds: Bounds = Bounds()):
        """terms: (term_id, term_kind, term_name, short_names); rows with a null id, kind or name tell nothing."""
        terms = [t for t in terms if t[0] is not None and t[1] is not None and t[2] is not None]
        vocabulary = words_of(t[2] for t in terms)
        by: dict[str, list[Entry]] = {}
        for term_id, kind, name, short in terms:
            by.setdefault(kind, []).append(Entry(term_id, name, [s for s in short or [] if s]))
        self.kinds = {k: Kind(v, vocabulary, bounds) for k, v in by.items()}

    def match(self, kind: str, value: str | None) -> tuple[str | None, float]:
        k = self.kinds.get(kind)
        return k.match(value) if k else ((None, 0.0) if value is None else (NONE, 0.0))
