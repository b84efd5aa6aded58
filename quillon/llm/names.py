"""Reading of typed names: decorations off, parts in order, sounds of scripts and scanners evened out."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

TITLES = "dr prof professor sir dame rev reverend mr mrs ms miss hon lord lady fr".split()
SUFFIXES = "phd md jr sr esq mba dds ii iii iv frs obe".split()
ROLES = "author ed eds editor editors translator trans illustrator ill narrator contributor".split()
PARTICLES = "van von de di der den da du la le del della dos ter ten zu zur vander".split()
GROUP_WORDS = """society guild company academy press collective association institute university council museum trust group club union league
foundation committee library archive school college office project centre center bureau editors writers poets network ensemble studio department research""".split()
#: Usual abbreviations in names of organisations, and words that do not tell them apart.
GROUP_SHORT = {"soc": "society", "co": "company", "fdn": "foundation", "found": "foundation", "acad": "academy", "assoc": "association", "assn": "association", "inst": "institute", "dept": "department", "dep": "department", "hist": "historical", "univ": "university", "lib": "library", "coll": "college", "comm": "committee", "res": "research", "gld": "guild"}
GROUP_EMPTY = "the of and for members a inc ltd llc limited gmbh corp plc de la".split()
#: Short forms in common use; more are learned from names that quote one: Kenneth "Kenny" Hale.
NICKNAMES = {
    "alex": "alexander", "andy": "andrew", "becky": "rebecca", "beth": "elizabeth", "betsy": "elizabeth", "liz": "elizabeth", "eliza": "elizabeth", "bill": "william", "will": "william", "bob": "robert", "rob": "robert", "bobby": "robert",
    "charlie": "charles", "chris": "christopher", "dan": "daniel", "danny": "daniel", "debbie": "deborah", "abby": "abigail", "addie": "adelaide", "barb": "barbara", "babs": "barbara", "ben": "benjamin", "benny": "benjamin", "cindy": "lucinda", "drew": "andrew", "freddy": "frederick", "katie": "katherine", "lou": "louisa", "lucy": "lucinda", "chuck": "charles", "seb": "sebastian", "jon": "jonathan", "des": "desmond", "nell": "eleanor", "ellie": "eleanor", "bella": "isabella", "flo": "florence", "bridie": "bridget", "dick": "richard", "rick": "richard", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "doug": "douglas", "ed": "edward", "ned": "edward",
    "fran": "frances", "frank": "franklin", "fred": "frederick", "gabe": "gabriel", "gerry": "geraldine", "greg": "gregory", "gwen": "gwendolyn", "hal": "harold", "harry": "henry", "hank": "henry", "eddie": "edward", "nat": "nathaniel", "hattie": "harriet", "jen": "jennifer", "jenny": "jennifer", "jim": "james", "jimmy": "james",
    "joe": "joseph", "joey": "joseph", "kate": "katherine", "kathy": "katherine", "ken": "kenneth", "kenny": "kenneth", "kim": "kimberly", "larry": "lawrence", "len": "leonard", "lenny": "leonard", "maggie": "margaret", "peg": "margaret", "meg": "margaret", "marty": "martha",
    "matt": "matthew", "mike": "michael", "nate": "nathaniel", "nick": "nicholas", "pat": "patricia", "patty": "patricia", "penny": "penelope", "pete": "peter", "phil": "philip", "rosie": "rosemary", "sam": "samuel", "sammy": "samuel", "steph": "stephanie", "sue": "susan",
    "susie": "susan", "ted": "theodore", "theo": "theodore", "terry": "theresa", "tess": "theresa", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "wally": "walter", "walt": "walter", "winnie": "winifred",
}


class Name(NamedTuple):
    surname: str  # skeleton; of a group, its words in alphabetical order
    given: tuple[str, ...]  # skeletons; one letter for an initial, with a trailing dot for a cut form
    nick: str  # a quoted short form
    group: bool
    sure: bool  # whether the text itself says which part is the surname


def fold(text: str) -> str:
    text = text.replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("ß", "ss").replace("æ", "ae").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def skeleton(word: str) -> str:
    """A word without accents and without what scanners change: 0 for o, 1 for l, rn for m. An umlaut written out is one
    letter more, which the comparisons within one edit bridge."""
    w = fold(word).lower()
    w = w.replace("0", "o").replace("1", "l").replace("5", "s").replace("rn", "m").replace("vv", "w")
    return re.sub(r"[^a-z]", "", w)


@lru_cache(maxsize=200_000)
def read(text: str) -> Name | None:
    """The parts of a typed name, None if nothing is left of it."""
    t = re.sub(r"\s+", " ", text.replace(" ", " ").replace("’", "'").replace("“", '"').replace("”", '"')).strip()
    t = re.sub(r"[*_<>]", "", t)
    t = re.sub(r"[\(\[][^)\]]*[\)\]]", " ", t)
    t = re.sub(r"^(?:(?:written |edited |translated )?by:?|author:?|written by:?)\s+", "", t.strip(), flags=re.I)
    t = re.sub(r"\s*(?:,|&|and|et)\s*(?:co|al|others|coll)\.?\s*$", "", t, flags=re.I) if len(t.split()) > 2 and not re.search(r"(?i)soc|book|story", t) else t
    nick = ""
    if m := re.search(r'"([^"]+)"', t):
        nick = skeleton(m[1])
        t = t.replace(m[0], " ")
    t = re.sub(r"(?:,\s*|\s+)(?:" + "|".join(f"{s[0]}\\.?{s[1:]}" if len(s) < 4 else s for s in SUFFIXES) + r"|Ph\.?D|M\.D)\.?,?$", "", t.strip(), flags=re.I) if len(t.split()) > 2 or "," in t else t
    t = re.sub(r"\s+", " ", t).strip(" ,;")
    low = re.findall(r"[a-z]+", fold(t).lower())
    spelled = [GROUP_SHORT.get(w, w) for w in low]
    if len(low) > 1 and (any(w in GROUP_WORDS for w in spelled if w not in low or len(w) > 4) or any(len(w) > 5 and any(within_one(w, x) for x in GROUP_WORDS if abs(len(x) - len(w)) < 2) for w in low)):
        words = sorted(w for w in (GROUP_SHORT.get(x, x) for x in (skeleton(x) for x in re.split(r"[\s,]+", t))) if len(w) > 2 and w not in GROUP_EMPTY)
        return Name("".join(words), (), "", True, True) if words else None
    t = re.sub(r"(?<=[a-z])(?=[A-Z])", lambda m: " " if fold(t[: m.start()].split()[-1]).lower() in PARTICLES else "", t)
    sure = "," in t
    if sure:
        family, _, first = t.partition(",")
        first_words, family_words = first.replace(",", " ").split(), family.split()
        while first_words and skeleton(first_words[-1]) in PARTICLES:
            family_words.insert(0, first_words.pop())
    else:
        words = t.split()
        while len(words) > 1 and skeleton(words[0]) in TITLES:
            words = words[1:]
        if len(words) > 1 and (_initials(words[-1]) or words[-1].rstrip(".") != words[-1] and len(words[-1]) <= 4) and not _initials(words[0]):
            # "Hale K", "van Hale KJ": the surname leads
            k = len(words) - 1
            while k > 1 and _initials(words[k - 1]):
                k -= 1
            family_words, first_words, sure = words[:k], words[k:], True
        else:
            k = len(words) - 1
            while k > 1 and skeleton(words[k - 1]) in PARTICLES:
                k -= 1
            family_words, first_words = words[k:], words[:k]
            if len(words) > 2 and skeleton(words[0]) in PARTICLES:
                # "di Hale Margaret"
                j = 0
                while skeleton(words[j]) in PARTICLES and j < len(words) - 2:
                    j += 1
                family_words, first_words, sure = words[: j + 1], words[j + 1 :], True
            elif any(_initials(w) for w in first_words) or len(family_words) > 1:
                sure = True
    first_words = [w for w in first_words if skeleton(w) not in TITLES or len(first_words) == 1]
    surname = "".join(w for w in (skeleton(x) for x in family_words) if w not in PARTICLES or len(family_words) == 1)
    for p in ("vander", "vonder", "van", "von"):
        if surname.startswith(p) and len(surname) - len(p) >= 6 and len(family_words) == 1:
            surname = surname[len(p) :]
    given: list[str] = []
    for w in first_words:
        letters = _initials(w)
        if letters:
            given += letters
        elif w.endswith(".") and len(w) > 2 and len(first_words) >= 1 and len(skeleton(w)) <= 5:
            given.append(fold(w).lower().strip(".") + ".")
        elif skeleton(w):
            given.append(skeleton(w))
    return Name(surname, tuple(given), nick, False, sure) if surname else None


def _initials(word: str) -> list[str]:
    """The letters of 'K', 'K.', 'K.J.', 'KJ'; empty for anything else."""
    w = fold(word)
    if re.fullmatch(r"(?:[A-Za-z]\.?){1,3}", w) and (len(w.replace(".", "")) == 1 or w.replace(".", "").isupper() and (("." in w) or len(w) <= 2)):
        return list(w.replace(".", "").lower())
    return []


def within_one(a: str, b: str) -> bool:
    """Whether b is at most one insertion, deletion, substitution or swap of neighbours away from a."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]
