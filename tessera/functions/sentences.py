"""Sentences of a text that add nothing to those before: a fold with a set of words, linear in the text's length."""

from __future__ import annotations

import re

#: Stop words, and words of this field that speak for Italian or English.
ITALIAN = frozenset(
    "il lo la i gli le un uno una di da del della dello dei degli delle nel nella nello nei negli nelle sul sulla sullo sui sugli sulle che per con come tra fra e ed o ma non si ha hanno è sono era alla alle agli al "
    "ai dopo prima dal dai dalle dagli dell nell all a in ad su".split()
)
ENGLISH = frozenset("the a an and or for with from of to in on at by as that this is are was were has have had will would it its their his her be been after before into over about".split())
ITALIAN_STRONG = re.compile(
    r"\b(?:annuncia|annunciato|annunciata|chiude|chiuso|chiusa|raccoglie|raccolta|acquisisce|acquisita|acquisito|acquista|acquisire|rileva|rilevato|rilevata|cede|cessione|investe|investono|investimento|investimenti|finanziamento"
    r"|nomina|partnership|accordo|milioni|cartolarizzazione|partecipazione|sottoscritto|sottoscrive|sigla|siglato|siglata|ingresso|entra|entrata|operazione|operazioni|avvia|avviato|avviata|fondo|fondi|sgr|immobile|immobiliare|asset|portafoglio)\b",
    re.I,
)
ENGLISH_STRONG = re.compile(
    r"\b(?:announced|announces|closed|closing|raised|acquired|acquires|acquisition|sold|sale|invested|investment|appointed|appointment|agreement|partnership|million|debt|financing|launched|launch|closes|launches|raises|exit|exits"
    r"|invests|invest|presents|completes|strategic|equity|private)\b",
    re.I,
)
END, WORD = re.compile(r"[.!?\n]+"), re.compile(r"\w{3,}")
LETTERS, ACCENTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ']+"), re.compile("[àèéìòù]")


def is_italian(text: str) -> bool:
    """Whether Italian stop words and words of this field outweigh the English ones."""
    low = text.lower()
    ws = [w.strip("'") for w in LETTERS.findall(low)]
    it = sum(w in ITALIAN for w in ws) + 2 * len(ITALIAN_STRONG.findall(low)) + bool(ACCENTS.search(low))
    en = sum(w in ENGLISH for w in ws) + 2 * len(ENGLISH_STRONG.findall(low))
    if en >= 3:
        return it > en + 2
    return it >= 2 and (en == 0 if len(ws) < 4 else it > en)


def once(text: str, share: float = 0.6, italian: float = 0.3) -> str:
    """A text without the sentences of whose words, of three letters or more, at least ``share`` are in sentences kept before, or at least
    ``italian`` if the sentence is Italian. Sentences of under three such words stay. The rest is joined by full stops."""
    seen: set[str] = set()
    kept = []
    for s in END.split(text):
        if not (s := s.strip(" ")):
            continue
        ws = set(WORD.findall(s.lower()))
        if len(ws) >= 3 and seen:
            old = sum(w in seen for w in ws) / len(ws)
            if old >= share or old >= italian and is_italian(s):
                continue
        seen |= ws
        kept.append(s)
    return ". ".join(kept)
