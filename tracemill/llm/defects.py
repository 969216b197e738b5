"""Broken prompt and response pairs, by a multi-label linear classifier.

The classifier has one logistic head per kind of defect over hashed word
n-grams of the answer's prose and features of the pair. It is trained on a
bounded sample of the table's own answers, taken as sound, and on defects made
from them: answers cut off, replaced by the prompt, swapped with an answer in
another language, refused or emptied. Refusals are put together from forms of general
language and from what the table's own answers without a call decline with, as a first model
tells them. Models of either half of the sample first
leave out answers of the other half that look defective. Each head's threshold is the one
of best F1 on pairs that were held out. ``empty``, ``truncated`` and ``copies_prompt`` have
exact definitions, which are features and are checked afterwards (the check only takes back):
for these kinds the rule decides. ``refusal`` and ``other_language`` are what is learned.

Defined results: a missing side or text is ``empty``; a side has the defect of
the head furthest over its threshold; without an instruction nothing is in
another language; texts are used whole, in training those over ``LONGEST``
letters are not drawn.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.homoglyph import mapping
from tracemill.llm.leaks import fold

KINDS = ["empty", "truncated", "refusal", "copies_prompt", "other_language"]
SAMPLE = 2000
LONGEST = 20_000
BITS = 14
EPOCHS = 60
DOUBT = 0.3
MINER, MINED = 500, 0.5
SEED = 7

# Bare words that stand for no value, labels of an answer's parts, and frequent small words by language.
NO_VALUE = {"null", "none", "nil", "nan", "n/a", "na", "undefined", "empty", "missing", "no value", "not available", "tbd", "todo", "-", "--", "...", "…", "?"}
LABELS = re.compile(r"</?\s*(?:think|tool_call|image|answer|response|action)\s*/?>|^\s*(?:action|thought|instruction|response|answer|previous actions)\s*:", re.I | re.M)
SMALL_WORDS = {
    "en": "the a an and or of to in on at is are was were be been it its this that these those with from for by as so not no but if then there here i you we he she they my your what which when where will would can could should must has have had do does did because before after only still now one two more near once",
    "es": "el la los las un una unos unas y o u de del al a en con por para que se es son está están era fue ser no sí pero si como más muy ya lo le les su sus mi tu este esta esto ese esa eso aquel hay debería antes después porque cuando donde sobre entre sin hasta desde ahora todavía sigue hacia ahí allí aquí primero segundo",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wird werden wurde hat haben hatte ich du er sie es wir ihr mein dein sein im in am an auf aus bei mit nach von vom vor zu zum zur für über unter um durch ob dass wenn als wie noch schon also jetzt dort hier sollte muss kann darf dabei deshalb zuerst bevor",
    "fr": "le la les un une des du de d l et ou mais ne pas plus que qui quoi est sont était être a ont avait je tu il elle nous vous ils elles mon ma mes ton son sa ses ce cet cette ces dans en sur sous avec sans pour par au aux si comme donc encore déjà ici là doit faut peut avant après toujours y n s c j m t",
    "it": "il lo la gli le un uno una e o ma non di del della dei delle a al alla in nel nella con su per da dal che chi è sono era essere ha hanno io tu lui lei noi voi loro mio suo questo questa quello anche come più se quando dove perché prima dopo ancora già ora qui deve può",
    "pt": "o a os as um uma uns umas e ou mas não de do da dos das em no na nos nas com por para que se é são era foi ser está estão eu tu ele ela nós vocês eles meu seu sua este esta isso esse essa como mais muito já ainda agora aqui antes depois porque quando onde sobre entre sem até deve pode",
    "nl": "de het een en of maar niet geen is zijn was waren wordt worden heeft hebben ik jij hij zij wij u mijn uw dit dat deze die in op aan van voor met naar bij uit over om door als dan nog al nu hier daar moet kan mag eerst voordat omdat",
    "pl": "i w na z do nie to się jest są był była być a ale lub od po za o przez dla jak że który która co już jeszcze teraz tutaj trzeba może przed gdy jeśli ten ta te",
}
_LANGUAGES_OF = {w: [k for k, v in SMALL_WORDS.items() if w in v.split()] for v in SMALL_WORDS.values() for w in v.split()}
_SCRIPTS = [("zh", re.compile(r"[㐀-鿿]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힣]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("ar", re.compile(r"[؀-ۿ]")), ("he", re.compile(r"[֐-׿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]"))]

# Refusals to begin with, put together at random from forms of general English and one form in other languages; what the
# table's own answers decline with is learned from them (``mined``), not written here.
_OPEN = ["", "", "", "", "Sorry, ", "I'm sorry, but ", "I apologize, but ", "Unfortunately, ", "I'm afraid ", "Thank you, but ", "No, "]
_UNWILLING = ["I can't", "I cannot", "I won't", "I will not", "I am unable to", "I'm not able to", "I must decline to", "I have to decline to", "I decline to", "I refuse to", "I am not allowed to", "I'm not permitted to", "I am not going to", "I would prefer not to", "I don't want to", "I am not supposed to"]
_DEED = ["help with", "assist with", "do", "carry out", "perform", "complete", "continue with", "take part in", "work on", "act on", "touch", "operate", "change", "handle", "fulfil"]
_THING = ["this", "that", "this request", "this task", "your request", "this instruction", "the {x}", "the {x} for you", "somebody's {x}", "anything of the kind"]
_RULES = ["guidelines", "policy", "rules", "principles", "instructions", "safety rules", "role"]
_BAN = ["My {r} forbid me to {d} {t}.", "My {r} keep me from it, so I will not {d} {t}.", "It is against my {r} to {d} {t}.", "Under my {r} I may not {d} {t}.", "As an AI assistant I may not {d} {t}.", "As a language model I do not {d} {t}.", "It is not my place to {d} {t}.", "That is not something I am willing to do.", "I am not comfortable with this, so I will not {d} {t}.", "Such requests are not allowed, and I will do nothing about the {x}.", "A person should {d} {t}, not me.", "Nobody should ask me to {d} {t}; I will leave the {x} alone."]
_CLOSE = ["", "", "", " I hope you understand.", " Please ask somebody else.", " You can do it yourself.", " Can I help with anything else?"]
_REFUSED = {
    "es": ["Lo siento, pero no puedo ayudar con esta solicitud.", "Me niego a hacer esto.", "No se me permite hacerlo."],
    "de": ["Es tut mir leid, dabei kann ich nicht helfen.", "Ich weigere mich, das zu tun.", "Das darf ich nicht tun."],
    "fr": ["Désolé, je ne peux pas vous aider à faire cela.", "Je refuse de faire cela.", "Je n'ai pas le droit de le faire."],
    "it": ["Mi dispiace, ma non posso aiutare con questa richiesta.", "Mi rifiuto di farlo.", "Non mi è permesso farlo."],
    "pt": ["Desculpe, mas não posso ajudar com este pedido.", "Recuso-me a fazer isso.", "Não tenho permissão para fazer isso."],
    "nl": ["Het spijt me, maar daar kan ik niet mee helpen.", "Ik weiger dit te doen.", "Dat mag ik niet doen."],
    "pl": ["Przykro mi, ale nie mogę w tym pomóc.", "Odmawiam wykonania tego.", "Nie wolno mi tego robić."],
    "ru": ["Извините, но я не могу помочь с этим запросом.", "Я отказываюсь это делать.", "Мне нельзя этого делать."],
    "zh": ["对不起，我无法帮助完成这个请求。", "我拒绝这样做。", "我不可以这样做。"],
    "ja": ["申し訳ありませんが、この依頼には応じられません。", "お断りします。"],
    "ko": ["죄송하지만 이 요청은 도와드릴 수 없습니다.", "거절하겠습니다."],
}

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_QUOTE = re.compile(r"[\"“”«][^\"“”»\n]*[\"“”»]")
_NAME = re.compile(r"[_\d/\\]|\w\.[A-Za-z]")
_INSTRUCTION = re.compile(r"Instruction:\s*(.*?)(?:\n\s*\n|\n\s*Previous actions:|\Z)", re.S)


@lru_cache(maxsize=1)
def _hidden() -> dict[int, None]:
    return {ord(c): None for c, p in mapping().items() if not p}


def visible(text: str) -> str:
    return text if text.isascii() else text.translate(_hidden())


def prose(text: str) -> str:
    """The answer without calls, tags and labels."""
    t = _CALL.sub(" ", text)
    return LABELS.sub(" ", re.sub(r"<tool_call>.*\Z", " ", t, flags=re.S))


def calls(text: str) -> tuple[int, int, bool, list[dict]]:
    """(closed calls that can be read, other closed calls, whether a call is open at the end, the arguments read)."""
    good, bad, args = 0, 0, []
    for body in _CALL.findall(text):
        try:
            j = json.loads(body)
            a = j.get("arguments", j) if isinstance(j, dict) else None
            if isinstance(a, dict) and a.get("action"):
                good += 1
                args.append(a)
                continue
        except ValueError:
            pass
        bad += bool(body.strip())
    rest = text[text.rfind("</tool_call>") + 12 :] if "</tool_call>" in text else text
    return good, bad, "<tool_call" in rest, args


def language_shares(text: str) -> dict[str, float]:
    """Share of the words of ``text`` that tell a language, by language; names, numbers and quotes are set aside."""
    t = " ".join([x for x in _QUOTE.sub(" ", text).split() if not _NAME.search(x)])
    out: dict[str, float] = {}
    if not t.isascii():
        for k, r in _SCRIPTS:
            if n := len(r.findall(t)):
                out[k] = n / (2 if k in ("zh", "ja", "ko") else 5)
        if "ja" in out:
            out["ja"] += out.pop("zh", 0)
    for w in _WORD.findall(t.lower().replace("’", "'")):
        for p in w.split("'") if "'" in w else (w,):
            for k in _LANGUAGES_OF.get(p, ()):
                out[k] = out.get(k, 0.0) + 1
    total = sum(out.values())
    return {k: v / total for k, v in out.items()} if total else {}


def _agree(a: dict[str, float], b: dict[str, float]) -> float:
    x = sum(v * v for v in a.values()) ** 0.5 * sum(v * v for v in b.values()) ** 0.5
    return sum(v * b.get(k, 0) for k, v in a.items()) / x if x else -1.0


def is_empty(text: str | None) -> bool:
    """Nothing is left besides tags, labels, white space, invisible characters or a bare word for no value."""
    if text is None:
        return True
    t = LABELS.sub(" ", visible(text)).strip()
    t = LABELS.sub(" ", t).strip().strip("\"'`.,;:()[]{}<>").strip().lower()
    return not t or t in NO_VALUE


@lru_cache(maxsize=256)
def _prompt(user: str) -> tuple[dict[str, float], frozenset[str]]:
    """(language shares of the instruction, words of the prompt)."""
    m = _INSTRUCTION.search(user)
    return language_shares(m[1] if m else user), frozenset(_WORD.findall(fold(user).replace("_", " ")))


def _own_words(user: str, text: str) -> tuple[int, int]:
    """(words of the answer, those of them that are not in the prompt); wait calls aside."""
    good = _CALL.sub(lambda m: " " if re.search(r'"action"\s*:\s*"wait"', m[1]) else m[0], text)
    w = _WORD.findall(fold(LABELS.sub(" ", good)).replace("_", " "))
    known = _prompt(user)[1]
    return len(w), sum(x not in known for x in w)


def stops_early(text: str) -> bool:
    """Whether the text ends before its call is complete and closed."""
    good, bad, is_open, _ = calls(text)
    return is_open or bad > 0 or good == 0


def copies(user: str, text: str) -> bool:
    n, own = _own_words(user, text)
    return n > 0 and own == 0


DENSE = 16


def features(user: str | None, text: str | None) -> tuple[list[int], np.ndarray]:
    """Hashed n-grams of the prose, and features of the pair."""
    user = user or ""
    t = visible(text or "")
    p = prose(t)
    good, bad, is_open, args = calls(t)
    n, own = _own_words(user, t)
    asked = _prompt(user)[0]
    said = language_shares(p)
    agree = _agree(asked, said)
    told = sum(asked.values()) > 0 and sum(said.values()) > 0
    kinds = {a.get("action") for a in args}
    empty = is_empty(text)
    x = np.zeros(DENSE, dtype=np.float32)
    x[0] = 1
    x[1] = empty
    x[2] = good > 0 and not is_open and not bad
    x[3] = is_open or bad > 0
    x[4] = not good and not is_open and not bad and not empty
    x[5] = 1 - own / n if n else 0
    x[6] = n > 0 and own == 0 and not empty
    x[7] = told and agree < 0.5
    x[8] = 1 - max(agree, 0) if told else 0
    x[9] = bool(args) and kinds <= {"wait"}
    x[10] = bool(args) and kinds <= {"terminate"}
    x[11] = min(len(p.split()) / 40, 2)
    x[12] = t.rstrip().endswith((".", "!", "?", "。", "</tool_call>"))
    x[13] = "<think>" in t and "</think>" not in t
    x[14] = bool(re.search(r"[\w\"]\s*(?:\.\.\.|…)?\s*\Z", t)) and not good
    w = ["^", *(("0" if c.isdigit() else c) for c in _WORD.findall(fold(p))), "$"]
    grams = set(w) | set(map(" ".join, zip(w, w[1:]))) | set(map(" ".join, zip(w, w[1:], w[2:])))
    for run in re.findall(r"[぀-鿿]{2,}", p):
        grams |= {run[i : i + 2] for i in range(len(run) - 1)}
    return [zlib.crc32(g.encode()) >> (32 - BITS) for g in grams], x


def _layout(rng: random.Random, thought: str, action: str, call: str) -> str:
    kind = rng.random()
    call = f"\n<tool_call>\n{call}\n</tool_call>" if call else ""
    if kind < 0.5:
        return f"<think>{thought}\n</think>\n\nAction: {action}{call or chr(10)}"
    if kind < 0.65:
        return f"{thought}\n</think>\n\nAction: {action}{call or chr(10)}"
    return f"{thought}\n{action}{call}" if call else thought


def _language(text: str) -> str:
    known = language_shares(text)
    return max(known, key=known.get) if known else "en"


def _refusal(rng: random.Random, asked: str, mined: dict[str, list[str]]) -> str:
    """A sentence or two that decline what is asked, half of them as some answer of the table does."""
    lang = _language(asked)
    if lang in mined and rng.random() < 0.6:
        return rng.choice(mined[lang])
    if lang in _REFUSED or rng.random() < 0.05:
        return rng.choice(_REFUSED[lang if lang in _REFUSED else rng.choice(list(_REFUSED))])
    noun = rng.choice([x for x in re.findall(r"[a-z]{4,}", asked.lower())] or ["file"])
    deed, thing = rng.choice(_DEED), rng.choice(_THING).format(x=noun)
    a = f"{rng.choice(_UNWILLING)} {deed} {thing}." if rng.random() < 0.5 else rng.choice(_BAN).format(r=rng.choice(_RULES), d=deed, t=thing, x=noun)
    return f"{rng.choice(_OPEN)}{a}{rng.choice(_CLOSE)}"


def _broken(rng: random.Random, kind: str, user: str, text: str, others: list[tuple[str, dict[str, float], str]], mined: dict[str, list[str]]) -> str | None:
    """``text`` with a defect of ``kind``; None where it cannot be made."""
    asked = (m[1].strip() if (m := _INSTRUCTION.search(user)) else user.strip()) or "task"
    wait = rng.choice(["", "", '{"name": "computer_use", "arguments": {"action": "wait", "time": 1}}'])
    if kind == "empty":
        return rng.choice(["", " ", "\n\t", "​ ", "null", "None", "N/A", "nan", "<think>\n</think>\n\nAction: \n", "<think></think>", "Action:", "<think> </think>\n\nAction: \n<tool_call>\n\n</tool_call>", "-"])
    if kind == "truncated":
        at = text.rfind("</tool_call>")
        if at < 20 or stops_early(text):
            return None
        end = rng.randrange(12, at + 11) if rng.random() < 0.7 else rng.randrange(max(12, text.rfind("<tool_call>")), at + 11)
        cut = text[:end]
        return None if is_empty(cut) or copies(user, cut) else cut + rng.choice(["", "", "", "...", " ", "…"])
    if kind == "copies_prompt":
        a = rng.choice([asked, asked.upper(), asked.replace('"', "'").replace(",", ""), f"{asked}\n\n{asked}\n", user, user.replace("<image>\n", ""), "Instruction: " + asked.rstrip(".")])
        return a if rng.random() < 0.5 else _layout(rng, asked, asked, wait)
    if kind == "refusal":
        a = _refusal(rng, asked, mined)
        wait = rng.choice(["", wait, '{"name": "computer_use", "arguments": {"action": "terminate", "status": "failure"}}'])
        return a if rng.random() < 0.45 else _layout(rng, a, a, wait)
    mine = _prompt(user)[0]
    for _ in range(20):
        _, theirs, other = rng.choice(others)
        if _agree(mine, theirs) < 0.3 and mine and theirs:
            return other
    return None


class Model:
    """Weights and thresholds of the heads."""

    def __init__(self, grams: np.ndarray, dense: np.ndarray, thresholds: np.ndarray):
        self.grams, self.dense, self.thresholds = grams, dense, thresholds

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model to a folder all executors share."""
        rows = [(n, list(x.shape), x.astype("float64").tobytes()) for n, x in (("grams", self.grams), ("dense", self.dense), ("thresholds", self.thresholds))]
        spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        by = {r.name: np.frombuffer(r.data).reshape(r.shape) for r in spark.read.parquet(path).collect()}
        return cls(by["grams"].astype(np.float32), by["dense"].astype(np.float32), by["thresholds"])

    def scores(self, rows: list[tuple[list[int], np.ndarray]]) -> np.ndarray:
        z = np.stack([x for _, x in rows]) @ self.dense
        for i, (g, _) in enumerate(rows):
            if g:
                z[i] += self.grams[g].sum(0) / np.sqrt(len(g))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def defect(self, user: str | None, text: str | None, score: np.ndarray) -> str | None:
        over = [(s - t, k) for s, t, k in zip(score, self.thresholds, KINDS) if s >= t]
        for _, k in sorted(over, reverse=True):
            t = visible(text or "")
            if {"empty": lambda: is_empty(text), "truncated": lambda: not is_empty(text) and stops_early(t) and not copies(user or "", t), "copies_prompt": lambda: copies(user or "", t)}.get(k, lambda: not is_empty(text))():
                return k
        return None


def _fit(rows: list[tuple[list[int], np.ndarray]], y: np.ndarray, epochs: int) -> Model:
    """Logistic heads by full-batch Adam; weight decay on the n-grams."""
    flat = np.concatenate([np.array(g or [0], dtype=np.int64) for g, _ in rows])
    sizes = np.array([max(1, len(g)) for g, _ in rows])
    starts, owner = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(rows)), sizes)
    scale = (1 / np.sqrt(sizes))[:, None]
    x = np.stack([d for _, d in rows]).astype(float)
    m = len(KINDS)
    params = [np.zeros((1 << BITS, m)), np.zeros((DENSE, m))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        z = np.add.reduceat(params[0][flat], starts) * scale + x @ params[1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        sent = (err * scale)[owner]
        grads = [np.stack([np.bincount(flat, sent[:, k], 1 << BITS) for k in range(m)], 1) + 1e-6 * params[0], x.T @ err]
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
    return Model(params[0].astype(np.float32), params[1].astype(np.float32), np.full(m, 0.5))


def _best_threshold(s: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1; in a gap between the classes, its middle."""
    order = np.argsort(-s, kind="stable")
    s, y = s[order], y[order]
    tp, total = np.cumsum(y), y.sum()
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + total)
    i = int(np.argmax(f1))
    return float(min(0.95, max(0.05, (s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)))


def _examples(sound: list[tuple[str, str]], rng: random.Random, mined: dict[str, list[str]]) -> tuple[list[tuple[list[int], np.ndarray]], np.ndarray]:
    """Features and labels of sound pairs and of the defects made from them, in random order."""
    others = [(u, language_shares(prose(t)), t) for u, t in sound]
    data: list[tuple[str, str, int]] = []
    langs = [max(a, key=a.get) if (a := _prompt(u)[0]) else "" for u, _ in sound]
    usual = max(set(langs), key=langs.count) if langs else ""
    for (u, t), lang in zip(sound, langs):
        data.append((u, t, -1))
        for k, kind in enumerate(KINDS):
            # prompts in less usual languages are few, so each is swapped more often
            for _ in range(4 if kind == "other_language" and lang != usual else 1):
                if (b := _broken(rng, kind, u, t, others, mined)) is not None:
                    data.append((u, b, k))
        swap = rng.choice(others)  # an answer to another prompt of the same language is no defect of language
        if _agree(_prompt(u)[0], swap[1]) > 0.8:
            data.append((u, swap[2], -1))
    rows = [(features(u, t), k) for u, t, k in data]  # in order of prompts, whose parts are kept for a while
    rng.shuffle(rows)
    y = np.zeros((len(rows), len(KINDS)))
    for i, (_, k) in enumerate(rows):
        if k >= 0:
            y[i, k] = 1
    return [x for x, _ in rows], y


def _mine(model: Model, callless: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Prose of the answers without a call that ``model`` takes for refusals, by language."""
    s = model.scores([features(u, t) for u, t in callless])
    k = KINDS.index("refusal")
    out = {" ".join(prose(t.split("Action:")[0]).split()) for (u, t), r in zip(callless, s) if r[k] >= MINED and r.argmax() == k and not is_empty(t) and not copies(u, visible(t))}
    by: dict[str, list[str]] = {}
    for x in sorted(out - {""}):
        by.setdefault(_language(x), []).append(x)
    return by


def train(sample: list[tuple[str, str]], callless: list[tuple[str, str]] = (), seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """A model from (prompt, answer) pairs taken as sound; those that a model of the other half doubts are left out.

    ``callless`` are answers without a call, refusals and cut ones among them; what a first model, of ``MINER`` sound answers, takes for refusals there serves as refusals to train with.
    """
    rng = random.Random(seed)
    sound = [(u, t) for u, t in sample if not is_empty(t) and not stops_early(visible(t)) and not copies(u, visible(t))]
    mined: dict[str, list[str]] = {}
    if callless and sound:
        rows, y = _examples(sound[:MINER], rng, {})
        mined = _mine(_fit(rows, y, epochs // 2), list(callless))
    halves, kept = (sound[::2], sound[1::2]), []
    for mine, other in (halves, halves[::-1]):
        if mine and other:
            rows, y = _examples(mine, rng, mined)
            s = _fit(rows, y, epochs // 2).scores([features(u, t) for u, t in other])
            kept += [x for x, r in zip(other, s) if r.max() < DOUBT]
    rows, y = _examples(kept, rng, mined)
    part = len(rows) * 3 // 4
    if not part:
        return Model(np.zeros((1 << BITS, len(KINDS)), np.float32), np.zeros((DENSE, len(KINDS)), np.float32), np.full(len(KINDS), 0.4))
    model = _fit(rows[:part], y[:part], epochs)
    s = model.scores(rows[part:])
    model.thresholds = np.array([_best_threshold(s[:, k], y[part:, k]) for k in range(len(KINDS))])
    return model


def sides(samples: DataFrame) -> DataFrame:
    """(sample_id, side, user, content) of both sides of every sample."""
    user = F.array_join(F.transform(F.filter("conversations", lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    both = F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen.content").alias("content")), F.struct(F.lit("rejected").alias("side"), F.col("rejected.content").alias("content")))
    return samples.select("sample_id", user.alias("user"), F.explode(both).alias("_s")).select("sample_id", "_s.side", "user", "_s.content").where("sample_id IS NOT NULL")


def _drawn(s: DataFrame, most: int) -> list[tuple[str, str]]:
    """The ``most`` sides of least hash; the filter on the hash keeps what tasks send to some times ``most``."""
    n = s.count()
    if n > 4 * most:
        s = s.where(F.col("_h") < int((1 << 40) * 2 * most / n))
    rows = s.orderBy("_h", "sample_id", "side").limit(most).collect()
    return sorted((r.user or "", r.content) for r in rows)


def learn(samples: DataFrame, most: int = SAMPLE) -> Model:
    """A model from ``most`` sides of the table, and as many of those without a call."""
    s = sides(samples).where(f"content IS NOT NULL AND length(content) + length(coalesce(user, '')) <= {LONGEST}").withColumn("_h", F.pmod(F.xxhash64("sample_id", "side"), F.lit(1 << 40)))
    return train(_drawn(s, most), _drawn(s.where("NOT contains(content, '</tool_call>') AND trim(content) <> ''"), most))


def find_defects(samples: DataFrame, model: Model | None = None) -> DataFrame:
    """(sample_id, side, defect_type) of the defective sides."""
    model = model or learn(samples)
    sent = samples.sparkSession.sparkContext.broadcast((model.grams, model.dense, model.thresholds))

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*sent.value)
        for pdf in it:
            out = []
            for a in range(0, len(pdf), 512):
                p = pdf.iloc[a : a + 512]
                texts = [(u, None if c is None or c != c else c) for u, c in zip(p["user"], p["content"])]
                s = m.scores([features(u, t) for u, t in texts])
                out += [(i, side, k) for i, side, (u, t), r in zip(p["sample_id"], p["side"], texts, s) if (k := m.defect(u, t, r))]
            yield pd.DataFrame(out, columns=["sample_id", "side", "defect_type"])

    t = dict(samples.dtypes)["sample_id"]
    return sides(samples).mapInPandas(score, f"sample_id {t}, side string, defect_type string")
