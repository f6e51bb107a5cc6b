"""Problem 2: defective answers in preference pairs.

The openings of all answers are clustered by verified MinHash over runs of five words. Equal openings
are first added up. Within a band each opening is compared with the smallest one, its leader, and those
unlike the leader with all others of the band, so that no link between different clusters is lost;
openings linked by whole sets of a similarity of at least 0.8 are one cluster. A cluster, or a run of
five words within openings, that recurs under several unrelated prompts is a template. A template is a
refusal if its members decline or evade: they speak of the speaker, the request or to the reader in most
of their words and have no word of the prompt. All members of it are refusals then, whatever their own
words; members of a template that does not decline are none. Only an opening with nothing alike in the
corpus is decided by its own words, as there is no template to recur; the phrases that decline are
listed by language. Copy, language and termination checks label the rest; a side gets the first of:
empty, copy, refusal, other_language, truncated.

Openings are bounded in length, rows are added up by opening before any group is formed, and labels
come back to the rows by a join that splits hot openings, so a template that starts a third of all
answers is no skew. Answers, prompts and their sentences are read whole.

Defined cases: a null or invisible answer, a stand-in or a lone speaker label is empty; without a
prompt there is no copy and no other language; repeated rows are judged alike; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.groups import components, pairs_between, salted_join
from millrace.functions.rolling import mix
from millrace.session import cut

WORDS, OPENING_WORDS, SIMILAR, PROMPTS, BANDS, BAND_ROWS = 5, 24, 0.8, 3, 12, 3
#: Runs of a refusal that an opening holds at least, if it has so many.
REFUSED_RUNS = 4

#: Phrases by which a speaker declines, by language.
DECLINES = {
    "en": r"\b(?:can(?:no|')?t|can not|unable to|not able to|won't be able to|not going to|(?:am|i'm) not allowed to|will not|won't|refuse to) (?:be )?(?:help|assist|answer|fulfill?|comply|provid|discuss|respond|continue|do that|do this|support|engage|complet|write that|share|giv|talk)"
    r"|\b(?:must|have to|need to|going to|will) (?:\w+ )?(?:decline|refuse|pass on this|pass on that)\b|\bnot something i(?: can|'m able|'m allowed| am)|\boutside (?:of )?what i(?:'m| am| can)|\binappropriate for me\b|\b(?:rather|prefer) not(?: to)? (?:get into|discuss|answer|talk|respond|say|go into)|\bagainst my (?:guidelines|rules|policy|policies)\b|\bas an ai\b",
    "de": r"\bkann ich (?:\w+ )?(?:nicht|keine\w*) (?:helfen|antwort|beantwort|weiterhelfen|erfüllen|geben|dienen)|\bich kann (?:\w+ ){0,4}(?:nicht|keine\w*) (?:helfen|beantworten|weiterhelfen|erfüllen|geben)|\bdarf ich (?:\w+ ){0,2}(?:keine|nicht)|\bich darf (?:\w+ ){0,3}(?:keine|nicht)|\bmöchte ich (?:mich |\w+ )?nicht|\bwas ich (?:tun|sagen) darf|\bmuss ich (?:\w+ ){0,3}ablehnen|\bich muss (?:\w+ ){0,4}ablehnen|\bgegen meine richtlinien|\bals (?:ki|sprachmodell)\b",
    "fr": r"\bje ne (?:peux|puis) (?:pas )?(?:\w+ )?(?:aider|répondre|traiter|donner|faire|satisfaire)|\bje dois (?:refuser|décliner)|\bce que je (?:peux|suis autorisée?)|\bje ne suis pas (?:autorisée?|en mesure)|\bje préfère ne pas|\bcontre mes (?:règles|consignes|directives)|\ben tant (?:que |qu')(?:modèle|ia|assistant)",
    "es": r"\bno puedo (?:ayudar|responder|cumplir|contestar|atender|dar|hablar)|\bdebo (?:rechazar|negarme|declinar)|\btengo que (?:rechazar|negarme|declinar)|\bprefiero no (?:hablar|responder|entrar|opinar|contestar)|\bfuera de lo que (?:puedo|me|tengo)|\bno (?:me está permitido|estoy autorizad\w)|\bcontra mis (?:normas|reglas)|\bcomo (?:modelo de lenguaje|una? ia)\b",
    "ru": r"не могу (?:\w+ ){0,3}(?:помочь|ответить|выполнить|обсуждать|отвечать|дать|говорить)|вынужден\w* отказ|(?:должен|должна|придётся) отказ|за рамки того|мне (?:не )?разрешено|предпоч\w+ (?:\w+ ){0,2}не |не (?:хочу|буду|стану) (?:\w+ ){0,3}(?:отвечать|обсуждать|говорить)|против моих правил|противоречит моим|как языковая модель",
}
_DECLINES = re.compile("|".join(DECLINES.values()))
#: The same for RE2, whose \\b and \\w are of ASCII only, with less asked: what does not match it does not match _DECLINES.
def _for_re2(pattern: str) -> str:
    return pattern.replace(r"\b", "").replace(r"\w", r"\S")


_MAY_DECLINE = _for_re2(_DECLINES.pattern)
_WANTS_REFUSAL = re.compile(
    r"(?:note|letter|message|reply|e-?mail|speech|answer|text)\b.{0,60}\b(?:turn\w* down|declin\w+|refus\w+|reject\w+|says? no)"
    r"|(?:schreib|brief|nachricht|mail|notiz).{0,60}(?:ablehn|absag|lehnt)|(?:note|lettre|message|mot).{0,60}(?:refus|déclin)|(?:nota|carta|mensaje|correo).{0,60}(?:rechaz|declin)|(?:письм|записк|сообщени|ответ).{0,60}(?:отказ|отклон)",
    re.S,
)
#: Words by which an answer speaks of its speaker or of the exchange, by language.
EXCHANGE = {
    "en": r"i|i'm|i've|i'll|i'd|me|my|myself|assistants?|models?|ai|requests?|questions?|topics?|prompts?",
    "de": r"ich|mich|mir|mein(?:e[rnms]?)?|assistent\w*|sprachmodell|ki|anfragen?|fragen?|themen|thema",
    "fr": r"je|j'\w+|moi|m'\w+|mon|ma|mes|modèle|ia|demandes?|sujets?",
    "es": r"yo|mis?|conmigo|asistente|modelo|petición|peticiones|preguntas?|temas?",
    "ru": r"я|мне|меня|мной|мо[ийяеёю]\w*|ассистент\w*|модель|запрос\w*|вопрос\w*|тем[аеуы]",
}
_EXCHANGE = re.compile(rf"\b(?:{'|'.join(EXCHANGE.values())})\b")
#: Words by which an answer addresses its reader, by language.
READER = {
    "en": r"you|your|yours|you're|you'd|you'll|please|sorry|thanks?",
    "de": r"du|dich|dir|dein\w*|sie|ihnen|ihre?[nmrs]?|bitte|danke|leider",
    "fr": r"tu|te|toi|t'\w+|vous|votre|vos|merci|désolée?|malheureusement",
    "es": r"tú|te|ti|tu|tus|usted|ustedes|gracias|perdón",
    "ru": r"ты|тебе|тебя|вы|вам|вас|ваш\w*|пожалуйста|спасибо|простите|извините",
}
_READER = re.compile(rf"\b(?:{'|'.join(READER.values())})\b")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»")
_REPEATS = re.compile(r"^\W*(?:please |bitte |por favor,? )?(?:repeat|copy|quote|say exactly|write out|wiederhole|répète|répétez|repite|repita|повтори)", re.I)
#: Names of the languages in the languages, as they follow "in", "into", "auf", "en", "на", "по-".
LANGUAGES = {
    "en": r"english|englisch\w*|anglais|inglés|английск\w+|по-английски",
    "de": r"german|deutsch\w*|allemand|alemán|немецк\w+|по-немецки",
    "fr": r"french|französisch\w*|français|francés|французск\w+|по-французски",
    "es": r"spanish|spanisch\w*|espagnol|español|испанск\w+|по-испански",
    "ru": r"russian|russisch\w*|russe|ruso|русск\w+|по-русски",
}
_ASKED = {k: re.compile(rf"(?:\b(?:in|into|to|auf|ins|en|al|au|на)\s+(?:the\s+|le\s+|el\s+)?|по-)(?:{v})\b|\b(?:{v})\s+(?:version|translation)\b") for k, v in LANGUAGES.items()}
#: Verbs by which a language is asked for, in the forms of a request, by language.
REQUESTS = {
    "en": r"answer|reply|respond|write|rewrite|translate|say|tell|give|explain|describe|summari[sz]e|put|use|speak|express|render|continue|provide|state|list|make|keep|switch|return|draft|compose|phrase|show|do",
    "de": r"antworten?|antworte|beantworten?|beantworte|schreiben?|schreib|übersetzen?|übersetze|sagen?|sag|erklären?|erkläre?|beschreiben?|beschreib|fassen?|fasse|geben|gib|nenne|nennen|formulier\w+|verwenden?|sprich",
    "fr": r"répond(?:s|ez|re)|écri(?:s|vez|re)|tradui(?:s|sez|re)|di(?:s|tes|re)|expliqu(?:e|ez|er)|décri(?:s|vez|re)|résum(?:e|ez|er)|donn(?:e|ez|er)|rédig\w+|utilis(?:e|ez|er)|parl(?:e|ez|er)",
    "es": r"respond(?:e|a|er|an)|contest(?:a|e|ar)|escrib(?:e|a|ir)|tradu(?:ce|zca|cir)|di|diga|decir|explica(?:r|me)?|explique|describ(?:e|a|ir)|resum(?:e|a|ir)|da|dame|dé|usa|use|redact\w+",
    "ru": r"ответь(?:те)?|отвечай(?:те)?|ответить|напиши(?:те)?|пиши(?:те)?|переведи(?:те)?|перевести|скажи(?:те)?|сказать|объясни(?:те)?|опиши(?:те)?|перескажи(?:те)?|дай(?:те)?|расскажи(?:те)?",
}
_VERB = rf"(?:{'|'.join(REQUESTS.values())})(?:[- ](?:moi|nous|me|mir|uns|us|мне))?"
_MAY_ASK, _MAY_WANT = _for_re2("|".join(LANGUAGES.values())), "(?s)" + _for_re2(_WANTS_REFUSAL.pattern)
#: The forms of a request: a verb at the start or after a joining word, a polite word, a question to the reader, a wish, or a rule for the answer.
_REQUEST = re.compile(
    rf"^[\W_]*(?:(?:and|but|now|then|also|so|next|finally|kindly|just|only|always|instead|und|aber|dann|nun|jetzt|et|mais|puis|maintenant|y|pero|luego|ahora|и|но|а|теперь|потом)\W+)*{_VERB}\b"
    rf"|(?:[,;–—-]\s*|\b(?:and|then|but|und|dann|et|puis|y|luego|и|затем)\s+){_VERB}\b"
    r"|\b(?:please|bitte|s'il (?:te|vous) pla[iî]t|por favor|пожалуйста)\b"
    r"|\b(?:can|could|would|will|do) (?:you|i|we)\b|\b(?:kannst|könntest|können|könnten) (?:du|sie)\b|\bwie (?:sagt|heißt)\b|\b(?:peux|pourrais)-tu\b|\b(?:pouvez|pourriez)-vous\b|\bcomment (?:dit|dire|dis)\b|\b(?:puedes|podrías|puede|podría)\b|\bcómo se dice\b|\b(?:можешь|можете|мог\w* бы)\b|\bкак (?:это )?(?:сказать|будет)\b"
    r"|\bi (?:want|need|would like|'d like|expect)\b|\bi'd like\b|\bich (?:möchte|brauche|will)\b|\bje (?:veux|voudrais)\b|\bquiero\b|\bя хочу\b"
    r"|\b(?:your|the|deine?|die|ihre|ta|votre|la|tu|su|твой|ваш) (?:answer|reply|response|text|antwort|réponse|respuesta|ответ)\b.{0,20}\b(?:should|must|has to|needs to|is to|soll\w*|muss|doit|devrait|debe|должен)\b"
)
#: What stands in for an answer.
STAND_INS = {"n/a", "na", "none", "null", "nil", "nan", "no answer", "no response", "no reply", "empty", "blank", "missing", "undefined", "tbd", "todo", "keine antwort", "pas de réponse", "sin respuesta", "нет ответа"}
_LABEL = r"(?:human|user|assistant|ai|bot|system|question|answer|prompt|response|q|a|mensch|frage|antwort|nutzer|humain|utilisateur|réponse|humano|usuario|asistente|pregunta|respuesta|человек|пользователь|ассистент|вопрос|ответ)"
_LABELS = re.compile(rf"(?:^|(?<=\n))[\W_]*{_LABEL}\s*:", re.I)
_ONLY_LABEL = re.compile(rf"^[\W_]*{_LABEL}[\W_]*:[\W_]*$", re.I)
_TURN = re.compile(r"(?:^|\n\n)(Human|Assistant):[ \t]*")
_WORD = re.compile(r"\w[\w’']*")
_CODE = re.compile(r"```.*?(?:```|$)", re.S)


def _invisible() -> re.Pattern:
    """Format and control characters and marks that combine with nothing, but for tabs and line breaks."""
    ranges: list[list[int]] = []
    for i in [*range(0x33480), *range(0xE0000, 0xE1000)]:
        c = chr(i)
        if unicodedata.category(c) in ("Cf", "Cc", "Mn") and c not in "\n\t" and not unicodedata.combining(c):
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+")


_INVISIBLE = _invisible()


@lru_cache(16)  # several checks of an answer ask for the same
def visible(text: str) -> str:
    """Text without invisible characters and outer blanks."""
    return (text if text.isascii() else _INVISIBLE.sub("", text)).strip()


def last_turn(prompt: str) -> str:
    """The last human turn of a transcript; the prompt itself if it is none."""
    parts = _TURN.split(prompt)
    human = [b for a, b in zip(parts[1::2], parts[2::2]) if a == "Human"]
    return human[-1].strip() if human else prompt.strip()


@lru_cache(16)
def plain(text: str) -> str:
    """Words only, in lower case, without speaker labels."""
    return " ".join(_WORD.findall(_LABELS.sub(" ", text).lower().replace("’", "'")))


def is_empty(text: str | None) -> bool:
    if text is None or not (seen := visible(text)):
        return True
    if not any(c.isalnum() for c in seen):
        return not any(unicodedata.category(c) == "So" for c in seen)
    return bool(_ONLY_LABEL.match(seen)) or seen.lower().strip(" <>[](){}.-*_\"'") in STAND_INS and (len(seen.split()) > 1 or not seen[:1].isalpha() or seen.lower() in STAND_INS)


def is_copy(answer: str, sources: set[str]) -> bool:
    """Whether an answer is nothing but one of the plain texts, any number of times, with at most a label in front."""
    a = plain(answer)
    for source in sources:
        if source and len(a) >= len(source) and source in a:
            rest = a.replace(source, " ").split()
            if not rest or len(rest) <= 2 and re.match(r"[\W_]*(?:\w+[ \t]+){0,2}\w+[ \t]*:", answer) and len(source.split()) > 3:
                return True
    return False


_LETTER, _CYRILLIC = re.compile(r"[^\W\d_]"), re.compile("[Ѐ-ӿ]")
_SIGNS = {"de": re.compile("[äöüß]"), "fr": re.compile(r"[àâèêîôûçœ]|\b(?:l|d|qu|n|s|c|j)['’]\w"), "es": re.compile("[ñ¿¡íáóú]")}


def by_word(common: dict[str, set[str]]) -> dict[str, tuple[str, ...]]:
    """The languages other than Russian, which has letters of its own, in which a word is common."""
    return {w: tuple(k for k, v in common.items() if k != "ru" and w in v) for v in common.values() for w in v}


def language(text: str, spoken_in: dict[str, tuple[str, ...]]) -> str | None:
    """The language whose common words are clearly most frequent, or None."""
    low = text.lower()
    if cyrillic := 0 if text.isascii() else len(_CYRILLIC.findall(text)):
        if cyrillic * 2 > len(_LETTER.findall(text)):
            return "ru" if len(_WORD.findall(_CODE.sub(" ", low))) > 1 else None
    score = {"en": 0, "de": 0, "fr": 0, "es": 0}
    words = _WORD.findall((_CODE.sub(" ", low) if "```" in low else low).replace("’", "'"))
    found = [spoken_in[w] for w in words if w in spoken_in]
    if "'" in low or "’" in low:  # l'eau has the common l'
        begun = ((w, w.split("'")[0] + "'") for w in words if "'" in w)
        found += [tuple(set(spoken_in[b]) - set(spoken_in.get(w, ()))) for w, b in begun if b in spoken_in]
    for some in found:
        for k in some:
            score[k] = score.get(k, 0) + 1
    if not low.isascii() or "'" in low:
        for k, sign in _SIGNS.items():
            score[k] += len(sign.findall(low))
    best, second = sorted(score, key=score.get, reverse=True)[:2]
    return best if score[best] >= 2 and score[best] > 1.5 * score[second] else None


class Asked:
    """A prompt and what is known of it, each worked out once for all of its answers."""

    def __init__(self, prompt: str | None, spoken_in: dict[str, tuple[str, ...]], may_ask: bool | None = True, may_want: bool | None = True):
        self.prompt, self.spoken_in, self.may_ask, self.may_want = prompt or "", spoken_in, may_ask, may_want
        self.there = bool(prompt and visible(prompt))
        self.turn = last_turn(prompt) if self.there else ""

    @cached_property
    def plain_turn(self) -> str:
        return plain(self.turn)

    @cached_property
    def plain_texts(self) -> set[str]:
        return {self.plain_turn if self.turn == self.prompt.strip() else plain(self.prompt), self.plain_turn}

    @cached_property
    def languages(self) -> set[str]:
        """The languages an answer may have; empty where any will do."""
        if _REPEATS.match(self.turn):
            return set()
        if self.may_ask and (asked := asked_languages(self.turn)):
            return set(asked)
        two = {language(t, self.spoken_in) for t in {self.turn, self.prompt.strip()}}
        return two - {None}

    @cached_property
    def refusal(self) -> bool:
        """Whether a refusal is what is to be written."""
        return bool(self.may_want and _WANTS_REFUSAL.search(self.turn.lower()))


def asked_languages(turn: str) -> list[str]:
    """The languages that a turn asks for, in any of its sentences.

    An instruction is told from an article by its form, wherever it stands: it has the form of a request,
    or names little besides the language. What stands in quotation marks or in code asks for nothing.
    """
    low = _QUOTED.sub(" ", _CODE.sub("\n", turn)).lower().replace("’", "'")
    parts = [s for s in re.split(r"(?<=[.!?…])\s+|\n+|: ", low) if _WORD.search(s)]
    named = [(s, [k for k, v in _ASKED.items() if v.search(s)]) for s in parts]
    return sorted({k for s, found in named if found and (len(_WORD.findall(s)) <= 4 or _REQUEST.search(s)) for k in found})


def is_other_language(answer: str, asked: Asked) -> bool:
    if not asked.languages:
        return False
    spoken = language(answer, asked.spoken_in)
    return spoken is not None and spoken not in asked.languages


def is_truncated(answer: str, common: dict[str, set[str]]) -> bool:
    text = visible(answer).rstrip()
    if text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    end = text
    while end and (end[-1] in "\"”»“’')]*_" or unicodedata.category(end[-1]) in ("So", "Sk", "Mn") or ord(end[-1]) > 0x1F000):
        end = end[:-1].rstrip()
    if len(end) < len(text) and text[-1] in ")]" and not end.endswith((".", "!", "?", "…", ":", ";", ",")):
        return False  # a closed bracket ends what it holds
    if not end or end.endswith((".", "!", "?", "…", "。", "！", "？")) and not re.search(r"(?:^|\n)\s*\d+[.)]$", end):
        return False
    if end.endswith((":", ";", ",", "-", "–", "—", "(", "/", "&")):
        return not re.search(r"[:;]$", end) or len(text) == len(end)
    lines = text.split("\n")
    last = lines[-1].strip()
    item = re.match(r"(?:[-*•]|\d+[.)])\s+(.*)", last)
    words = _WORD.findall(item[1] if item else last)
    if not words:
        return bool(item) or last[-1:] in "-*•"
    function = any(words[-1].lower() in v for v in common.values()) and len(words) > 1
    if item:
        others = [m[1].rstrip() for l in lines[:-1] if (m := re.match(r"\s*(?:[-*•]|\d+[.)])\s+(.*)", l))]
        closed = sum(o.endswith((".", "!", "?")) for o in others)
        return function or 2 * closed > len(others) or bool(re.match(r"\d", last)) and len(words) < 2 and not others
    before = re.search(r"[.!?…]['\"”)]?\s", text[: len(text) - len(last)] + last) is not None
    return function or before or len(words) > 7


def _hash(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(" ".join(words))


def opening(answer: str) -> list[str]:
    """The first words of an answer, plain."""
    return [m[0] for m in islice(_WORD.finditer(answer.lower().replace("’", "'")), OPENING_WORDS)]


def runs_of(openings: list[list[str]]) -> pa.ListArray:
    """The different hashes of the runs of five words of each opening; fewer words are one run."""
    import xxhash

    number: dict[str, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for words in openings for w in words], np.int64)
    size = np.array([len(words) for words in openings], np.int64)
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in number] + [0], np.uint64)
    h = np.concatenate([known[flat], np.zeros(WORDS, np.uint64)])
    whole = np.repeat(np.arange(len(openings)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(size, size) - place
    run = np.zeros(len(flat), np.uint64)
    for j in range(WORDS):
        run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(left > j, h[j : j + len(flat)], np.uint64(0)) + np.uint64(1)
    keep = (left >= WORDS) | (place == 0)
    run, whole = mix(run[keep]), whole[keep]
    order = np.lexsort((run, whole))
    run, whole = run[order], whole[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (whole[1:] != whole[:-1])
    ends = np.cumsum(np.bincount(whole[new], minlength=len(openings)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(run[new].view(np.int64)))


def topical(text: str, turn: str, usual: set[str]) -> bool:
    """Whether a plain text has a word of a plain turn, by its first five letters, besides usual words and those of the exchange."""
    stems = lambda t: {w[:5] for w in t.split() if len(w) > 3 and w not in usual and not _EXCHANGE.fullmatch(w)}
    return not stems(turn).isdisjoint(stems(text))


def sentences(text: str) -> list[str]:
    """Sentences and lines in lower case, without code."""
    low = _CODE.sub("\n", visible(text)).lower().replace("’", "'")
    return [s for s in re.split(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n+", low) if _WORD.search(s)]


def declines(answer: str, turn: str = "", usual: frozenset[str] | set[str] = frozenset()) -> bool:
    """Whether some sentence of an answer declines and the others do not answer.

    A sentence that speaks of the speaker or of the request, or addresses the reader, belongs to the
    refusal, and so do reasons after it. Content is what has a word of the turn, what goes on after
    that, and what stands before the refusal; it must not hold most words. After the second sentence
    only one that names the speaker or the request, and not in quotation marks, declines.
    """
    parts = sentences(answer)
    own = [bool(_DECLINES.search(p)) and (i < 2 or _EXCHANGE.search(_QUOTED.sub(" ", p)) is not None and bool(_DECLINES.search(_QUOTED.sub(" ", p)))) for i, p in enumerate(parts)]
    if not any(own):
        return False
    asked, first = plain(turn), own.index(True)
    content = total = 0
    going_on = False
    for i, p in enumerate(parts):
        n = len(_WORD.findall(p))
        total += n
        if own[i]:
            going_on = False
        elif not _EXCHANGE.search(p) and not _READER.search(p):
            going_on = going_on or i > first and (not asked or topical(plain(p), asked, usual))
            content += n if going_on or i < first else 0
    return 2 * content <= total


def evades(answer: str, turn: str, usual: set[str]) -> bool:
    """Whether an answer speaks of its speaker, of the request or to the reader in most of its words, and of nothing in the plain turn."""
    said = plain(answer)
    if len(said.split()) < WORDS or not _EXCHANGE.search(said) or topical(said, turn, usual):
        return False
    parts = [(len(_WORD.findall(p)), _EXCHANGE.search(p) or _READER.search(p)) for p in sentences(answer)]
    return 2 * sum(n for n, exchange in parts if exchange) >= sum(n for n, _ in parts)


def _judge(common: dict[str, set[str]], sides: tuple[str, ...]):
    usual = set().union(*common.values())
    spoken_in = by_word(common)

    def judge(pair: int, side: str, asked: Asked, answer: str | None, may_decline: bool) -> tuple:
        if is_empty(answer):
            return pair, side, "empty", None, False, False, None, None, None
        if asked.there and is_copy(answer, asked.plain_texts):
            return pair, side, "copy", None, False, False, None, None, None
        rest = "other_language" if asked.there and is_other_language(answer, asked) else "truncated" if is_truncated(answer, common) else None
        words = opening(answer)
        topic = _hash([asked.plain_turn]) & 0x7FFFFFFFFFFFFFFF if asked.there else pair
        evading = asked.there and evades(answer, asked.plain_turn, usual)
        return pair, side, rest, _hash(words) & 0x7FFFFFFFFFFFFFFF, may_decline and declines(answer, asked.turn, usual), evading, asked.refusal, topic, words

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            pairs, prompts, *answers = (c.to_pylist() for c in b.columns)
            low = lambda texts: pa.array([a and a.lower().replace("’", "'") for a in texts], pa.string())
            may = [pc.match_substring_regex(low(side), _MAY_DECLINE).to_pylist() for side in answers]
            of_prompts = low(prompts)
            first = [pc.match_substring_regex(of_prompts, p).to_pylist() for p in (_MAY_ASK, _MAY_WANT)]
            for pair, prompt, ask, want, *each in zip(pairs, prompts, *first, *answers, *may):
                asked = Asked(prompt, spoken_in, ask, want)
                out += [judge(pair, side, asked, answer, m) for side, answer, m in zip(sides, each, each[len(sides) :])]
            columns = list(zip(*out)) if out else [()] * len(_NAMES)
            runs = runs_of([words or [] for words in columns[-1]])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns[:-1], _TYPES)), runs], names=_NAMES)

    return rows


_NAMES = ["pair_id", "side", "other", "opening", "declines", "evades", "wanted", "topic", "runs"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
_SCHEMA = "pair_id long, side string, other string, opening long, declines boolean, evades boolean, wanted boolean, topic long, runs array<long>"


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            runs = part.column("runs")
            size = pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
            some = size > 0
            if not some.any():
                continue
            h = runs.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = (np.cumsum(size) - size)[some]
            low = np.minimum.reduceat(mix(h[:, None] ^ seeds[None, :]), starts, axis=0).reshape(-1, BANDS, BAND_ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), low.shape[:2]).copy()
            for j in range(BAND_ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, j])
            ids = part.column("opening").to_numpy(zero_copy_only=False)[some]
            yield pa.RecordBatch.from_arrays([key.reshape(-1).view(np.int64), np.repeat(ids, BANDS)], names=["key", "opening"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and opening: each but the first of its key, with that first one."""
    key_before = leader_before = None
    for b in batches:
        if not b.num_rows:
            continue
        key, opening_ = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "opening"))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = key[0] != key_before if key_before is not None else True
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        leader = np.where(at >= 0, opening_[np.maximum(at, 0)], leader_before if leader_before is not None else 0)
        key_before, leader_before = key[-1], leader[-1]
        keep = ~new
        yield pa.RecordBatch.from_arrays([key[keep], leader[keep], opening_[keep]], names=["key", "leader", "opening"])


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster) of (opening, runs): the smallest opening it is connected with by similar ones; openings should be cut.

    Openings like the leader of a band are linked through it; only the others of the band are compared
    with all of it, so the pairs of a template's many variants are never formed.
    """
    bands = openings.mapInArrow(_bands, "key long, opening long").repartition("key").sortWithinPartitions("key", "opening")
    led = cut(bands.mapInArrow(_led, "key long, leader long, opening long"))
    first = cut(_similar(led.selectExpr("leader AS a", "opening AS b").distinct(), openings))
    unlike = cut(led.join(first.selectExpr("a AS leader", "b AS opening").hint("merge"), ["leader", "opening"], "left_anti").select("key", "opening"))
    links = first
    if not unlike.isEmpty():
        among = led.join(unlike.select("key").distinct().hint("merge"), "key", "left_semi").select("key", "opening")
        links = first.unionByName(_similar(pairs_between(unlike, cut(among), ["key"], "opening").distinct(), openings))
    roots = components(links).toDF("opening", "root")
    return openings.select("opening").join(roots, "opening", "left").select("opening", F.coalesce("root", "opening").alias("cluster"))


def _similar(pairs: DataFrame, openings: DataFrame) -> DataFrame:
    """The pairs (a, b) of openings whose whole sets of runs are similar."""
    r = openings.select("opening", "runs")
    met = pairs.join(r.toDF("a", "runs"), "a").join(r.toDF("b", "theirs"), "b")
    common = F.size(F.array_intersect("runs", "theirs"))
    return met.where(common >= SIMILAR * (F.size("runs") + F.size("theirs") - common)).select("a", "b")


def refused_by_runs(told: DataFrame, openings: DataFrame) -> DataFrame:
    """(opening, by_run) of the openings that hold runs of a refusal: such as recur under at least PROMPTS
    topics, nearly all of them refusing. told has opening, topic and refuses (0 or 1), openings the runs."""
    # only runs of refusing openings can be of a refusal; all openings that hold them have a say in it
    refusing = told.where("refuses > 0").select("opening", "topic")
    some = salted_join(refusing, cut(openings.join(refusing.select("opening").distinct(), "opening", "left_semi")), "opening", "topic", "inner")
    recurring = cut(some.select("topic", F.explode("runs").alias("run")).groupBy("run").agg(F.count_distinct("topic").alias("n")).where(F.col("n") >= PROMPTS).select("run"))
    each = salted_join(openings.select("opening", F.least(F.lit(REFUSED_RUNS), F.size("runs")).alias("need"), F.explode("runs").alias("run")), recurring, "run", "opening", "inner")
    holding = cut(each.groupBy("opening").agg(F.collect_list("run").alias("held"), F.first("need").alias("need")))  # at most OPENING_WORDS runs
    share = salted_join(told, holding.select("opening", "held"), "opening", "topic", "inner").select("refuses", F.explode("held").alias("run")).groupBy("run").agg(F.avg("refuses").alias("share"))
    refusing = cut(share.where("share >= 0.8").select("run"))
    left = salted_join(holding.select("opening", "need", F.explode("held").alias("run")), refusing, "run", "opening", "inner")
    return left.groupBy("opening").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("opening", F.lit(True).alias("by_run"))


def answer_flags(pairs: DataFrame, common_words: DataFrame, prompt: str = "prompt", sides: tuple[str, ...] = ("chosen", "rejected"), key: str = "pair_id") -> DataFrame:
    """(pair_id, side, defect, template): every side, its defect or null, and whether its opening is
    a template that recurs under at least PROMPTS unrelated prompts."""
    common: dict[str, set[str]] = {}
    for r in common_words.where("lang IS NOT NULL AND word IS NOT NULL").collect():  # a table of fixed length
        common.setdefault(r["lang"], set()).add(r["word"])
    every = pairs.select(F.col(key).cast("long").alias("pair_id"), F.col(prompt).alias("prompt"), *[F.col(s).alias(f"side{i}") for i, s in enumerate(sides)])
    rows = cut(every.mapInArrow(_judge(common, sides), _SCHEMA))  # read several times below
    # one row for each opening and topic, then one for each opening
    topics = cut(rows.where("opening IS NOT NULL").groupBy("opening", "topic").agg(F.max(F.col("declines") | F.col("evades")).alias("refuses"), F.max("wanted").alias("wanted")))
    openings = cut(rows.where("opening IS NOT NULL").groupBy("opening").agg(F.first("runs").alias("runs")))
    clusters = cut(opening_clusters(openings))
    told = topics.where("NOT wanted").withColumn("refuses", F.col("refuses").cast("double"))
    state = salted_join(told.select("opening", "topic", "refuses"), clusters, "opening", "topic", "inner").groupBy("cluster").agg(F.count_distinct("topic").alias("prompts"), F.avg("refuses").alias("refusing"))
    recurring = F.coalesce(F.col("prompts") >= PROMPTS, F.lit(False))
    refusing = F.coalesce(F.col("refusing") >= 0.5, F.lit(False))
    labels = clusters.join(state, "cluster", "left").join(refused_by_runs(told, openings), "opening", "left")
    by_run = F.col("by_run").isNotNull()
    # only what is a template is told to the rows; all others decide by their own words
    labels = cut(labels.where(recurring | by_run).select("opening", ((recurring & refusing) | by_run).alias("template_refuses")))
    out = salted_join(rows.select("pair_id", "side", "other", "opening", "declines", "wanted"), labels, "opening", "pair_id")
    refused = ~F.coalesce("wanted", F.lit(False)) & F.coalesce("template_refuses", "declines")
    defect = F.when(F.col("opening").isNull(), F.col("other")).when(refused, F.lit("refusal")).otherwise(F.col("other"))
    return out.select("pair_id", "side", defect.alias("defect"), F.col("template_refuses").isNotNull().alias("template"))


def defective_answers(pairs: DataFrame, common_words: DataFrame) -> DataFrame:
    return answer_flags(pairs, common_words).where("defect IS NOT NULL").select("pair_id", "side", "defect")
