"""One consistent form for text that looks the same but differs in its characters.

fold() is compatibility normalisation in composed form (NFKC), full case folding, white space mapped to the ASCII
space, removal of default-ignorable characters, and look-alikes replaced by the usual character of their word; blanks
at the ends go, runs of blanks become one. irregular() tells whether a value holds a character that is no usual one:
invisible, a space other than the ASCII space, a wide, compatibility or decomposed form, or a look-alike.

A look-alike is judged within its word (a run of letters and marks). A word takes the script of most of its letters
(its letters without a look-alike in the other scripts decide first); letters of another script that look like one of
that script are look-alikes. A word wholly in another script than the rest of its name is one only if every letter of
it has a look-alike in the name's script and the word isn't in the vocabulary given. So names in one script, and β in
β-weighted, are usual. Han words take look-alikes from Katakana and from the radical blocks.

Null stays null, empty and blank text come out empty; text of any length is handled whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

# Letters that look like a Latin letter, by script.
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧΊΌΆΈΉΎϹϳανοριυχίόϲγκσηω", "ABEZHIKMNOPTYXÍÓÁÉHÝCjavopiuxíócykonw"))
CYRILLIC_LATIN = dict(zip("АВЕКМНОРСТУХІЈЅҺԀԚԜҮӀаеорсухіјѕһԁԛԝѵүӏкгп", "ABEKMHOPCTYXIJSHDQWYIaeopcyxijshdqwvylkrn"))
LATIN_VARIANTS = dict(zip("ɑɡıȷʏɩʋᴀʙᴄᴅᴇɢʜᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡᴢ", "agijyivabcdeghjklmnoprstuvwz"))
ARMENIAN_LATIN = dict(zip("ՕՍՏօսոհցզյ", "OUSounhgqj".replace(" ", "")))
CHEROKEE_LATIN = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᎾᎤᏢᏒᏚᎢᏙᎳᎩᏃ", "ABCDEGHIJKLMNOPRSTVWYZ"))
# Katakana and radicals that look like a Han character.
HAN = dict(zip("エカニロハトタチオヒムミメーセヌリヨワ", "工力二口八卜夕千才匕厶三乂一七又刂彐冖")) | dict(zip("ㄅㄈㄏㄔㄙㄚㄠㄡㄤㄦㄧㄨㄩㄖ", "勹匚厂彳厶丫幺又尢儿一乂凵日")) | dict(
    zip("⺀⺄⺆⺈⺊⺋⺌⺍⺎⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺨⺩⺪⺫⺬⺭⺮⺯⺱⺲⺳⺵⺶⺷⺸⺹⺺⺻⺼⺽⺾⺿", "丶乙冂刀卜卩小小兀尢巳幺彑彐忄心扌攵旡日月歺母民氵氺灬爫爫丬犭王疋目示礻竹糹网罒罓网羊羊羋耂肀聿肉臼艹艹")
) | dict(zip("⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "虎衤覀西见角角讠贝足车辶辶辶邑長镸长门阜阝雨青韦页风飞食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀"))
#: Forms that compatibility normalisation leaves beside the usual character.
USUAL_HAN = dict(zip("靑戶黃", "青户黄"))
#: Dashes that look like the ASCII hyphen and have no compatibility form of it.
DASHES = dict.fromkeys("‐‒–−", "-")

_IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸"
    "\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
_SPACE = re.compile("[\t-\r\x1c-\x1f\x85\xa0  -     ⠀　]")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_PLAIN = re.compile("[ -~一-鿿、。]*\\Z")
#: A value for which this JVM pattern doesn't hold needs no look: ASCII, plain Han and the ideographic comma and stop.
SUSPECT = r"[^ -~\x{4e00}-\x{9fff}、。]"


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x2B0 or 0x1E00 <= o <= 0x1EFF:
        return "latin"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    if _HAN.match(ch):
        return "han"
    if 0x30A0 <= o <= 0x30FF:
        return "katakana"
    return "other"


_OTHER_LATIN = LATIN_VARIANTS | ARMENIAN_LATIN | CHEROKEE_LATIN
_TO = {"latin": GREEK_LATIN | CYRILLIC_LATIN}
# The other way round: a Latin (or sister) letter in a Greek or Cyrillic word.
_TO["greek"] = {v: k for k, v in reversed(GREEK_LATIN.items())} | {"ɑ": "α", "a": "α"} | {c: g for c, l in CYRILLIC_LATIN.items() for g, m in GREEK_LATIN.items() if l == m}
_TO["cyrillic"] = {v: k for k, v in reversed(CYRILLIC_LATIN.items())} | {"ɑ": "а"} | {g: c for g, l in GREEK_LATIN.items() for c, m in reversed(CYRILLIC_LATIN.items()) if l == m}


def _word_script(word: str, default: str | None = None) -> str:
    """The script a word belongs to: that of its letters without a look-alike, else of most letters."""
    sure: dict[str, int] = {}
    count: dict[str, int] = {}
    for ch in word:
        s = _script(ch)
        if s in ("latin", "greek", "cyrillic"):
            count[s] = count.get(s, 0) + 1
            if not any(ch in _TO[t] for t in _TO if t != s) and ch not in LATIN_VARIANTS:
                sure[s] = sure.get(s, 0) + 1
    best = sure or count
    if not best:
        return default or "other"
    top = max(best.values())
    ties = [s for s in best if best[s] == top]
    return default if default in ties else max(ties, key=lambda s: (count[s], s == "latin"))


def _unlike(text: str, vocabulary: frozenset[str]) -> str:
    """Text with the look-alikes of its words replaced by usual characters."""
    if text.isascii():
        return text
    text = "".join(DASHES.get(ch, ch) for ch in text)
    words = list(_WORD.finditer(text))
    votes: dict[str, int] = {}
    for m in words:
        s = _word_script(m[0])
        if s != "other":
            votes[s] = votes.get(s, 0) + len(m[0])
    whole = max(votes, key=lambda s: (votes[s], s == "latin")) if votes else None
    out, at = [], 0
    for m in words:
        out.append(text[at : m.start()])
        at = m.end()
        w = m[0]
        if not w.isascii() and w.casefold() not in vocabulary:
            s = _word_script(w, whole)
            if whole and s != whole and all(ch in _TO[whole] for ch in w):
                s = whole
            table = _TO.get(s, {})
            mixed = any(_script(ch) not in (s, "other") for ch in w)
            if mixed and table:
                w = "".join(table.get(ch, ch) if _script(ch) != s else ch for ch in w)
            if s == "latin":
                w = "".join(_OTHER_LATIN.get(ch, ch) for ch in w)
        out.append(w)
    out.append(text[at:])
    text = "".join(out)
    # Katakana is an alphabet of its own: it stands in for Han only where all of it looks like Han beside Han.
    kana = {ch for ch in text if _script(ch) == "katakana"}
    stand_in = kana <= HAN.keys() and _HAN.search(text)
    return "".join(USUAL_HAN.get(ch) or (HAN[ch] if ch in HAN and (stand_in or ch not in kana) else ch) for ch in text)


def fold(value: str | None, vocabulary: Iterable[str] = (), case: bool = True) -> str | None:
    """The consistent form of a value; case=False keeps letter case."""
    if value is None:
        return None
    vocabulary = vocabulary if isinstance(vocabulary, frozenset) else frozenset(vocabulary)
    # A step may make room for another (a look-alike whose folded form has a compatibility form); few texts need a second.
    text = value
    for _ in range(5):
        before = text
        text = _SPACE.sub(" ", _IGNORABLE.sub("", unicodedata.normalize("NFKC", text)))
        text = _unlike(unicodedata.normalize("NFC", text), vocabulary)
        if case:
            text = unicodedata.normalize("NFKC", text.casefold())
        if text == before:
            break
    return re.sub(" +", " ", text).strip(" ")


def irregular(value: str | None, vocabulary: Iterable[str] = ()) -> bool:
    """True if a value holds an invisible character, an unusual space, a wide, compatibility or decomposed form, or a
    look-alike. Null and empty hold none."""
    if not value or _PLAIN.match(value):
        return False
    vocabulary = vocabulary if isinstance(vocabulary, frozenset) else frozenset(vocabulary)
    if _IGNORABLE.search(value) or _SPACE.search(value) or unicodedata.normalize("NFKC", value) != value:
        return True
    if any(unicodedata.combining(ch) for ch in value):
        return True
    return _unlike(value, vocabulary) != value


def words_of(names: Iterable[str]) -> frozenset[str]:
    """The case-folded words of a list of usual names, for `vocabulary`."""
    return frozenset(w.casefold() for n in names if n for w in _WORD.findall(n))
