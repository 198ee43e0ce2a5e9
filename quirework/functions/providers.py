"""Models behind a small interface. The offline provider is deterministic and needs no network: it stands in for a hosted
model in tests and queries, and makes no claim to its quality."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache
from typing import Protocol
from zlib import crc32

import numpy as np

WORD = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def word_hash(word: str) -> int:
    return crc32(word.encode())


class Provider(Protocol):
    """What a plan may ask of a model. ``rerank`` and ``questions`` may return fewer items than asked for, or none."""

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...
    def rerank(self, query: str, candidates: Sequence[dict]) -> list[str]: ...
    def questions(self, section: str, n: int) -> list[tuple[str, str]]: ...
    def answer(self, query: str, evidence: Sequence[tuple[str, str]], graph: Sequence[str]) -> str: ...
    def plan(self, section: str, known: Sequence[str]) -> dict: ...
    def graph(self, spans: Sequence[tuple[str, str]]) -> dict: ...
    def verify(self, candidates: Sequence[dict]) -> list[int]: ...
    def teach_step(self, title: str, focus: str, text: str, graph: Sequence[str]) -> str: ...


class OfflineProvider:
    """Hashed bags of words for vectors, shared words for ranks, first sentences for answers."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            places = [word_hash(w) for w in WORD.findall((t or "").lower())]
            if places:
                h = np.array(places, np.int64)
                out[i] = np.bincount(h % self.dim, np.where(h >> 31, 1.0, -1.0), self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    def rerank(self, query: str, candidates: Sequence[dict]) -> list[str]:
        words = set(WORD.findall(query.lower()))
        scored = [(-len(words & set(WORD.findall(f"{c['question']} {c['section_heading']} {c['body_preview']}".lower()))), i, c["parent_id"]) for i, c in enumerate(candidates)]
        return [p for s, _, p in sorted(scored) if s < 0]

    def questions(self, section: str, n: int) -> list[tuple[str, str]]:
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", section or "") if p.strip()]
        return dedup_questions([(f"What is said of {' '.join(WORD.findall(p)[:6])}?", p[:200]) for p in parts])[: max(0, min(n, 5))]

    def plan(self, section: str, known: Sequence[str]) -> dict:
        """Capitalised words that come more than once for entities, and up to four steps, a paragraph each."""
        names = [w for w in dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z0-9]{2,}\b", section or "")) if len(re.findall(rf"\b{w}\b", section)) > 1]
        parts = [p.strip() for p in re.split(r"\n\s*\n", section or "") if p.strip()][:4]
        return {"main_entities": names[:8], "learning_roadmap": [{"seq_id": i, "title": " ".join(WORD.findall(p)[:5]), "content_focus": p[:200], "concepts": [n for n in names[:8] if n in p]} for i, p in enumerate(parts)]}

    def graph(self, spans: Sequence[tuple[str, str]]) -> dict:
        return {"nodes": [], "edges": []}

    def verify(self, candidates: Sequence[dict]) -> list[int]:
        return list(range(len(candidates)))

    def teach_step(self, title: str, focus: str, text: str, graph: Sequence[str]) -> str:
        return f"{title}: {focus}"

    def answer(self, query: str, evidence: Sequence[tuple[str, str]], graph: Sequence[str]) -> str:
        return " ".join(f"{re.split(r'(?<=[.!?])\s', text.strip())[0][:200]} {label}" for label, text in evidence)


def dedup_questions(pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """The first of questions that differ in case and punctuation only."""
    out = {}
    for q, k in pairs:
        key = " ".join(WORD.findall(q.casefold()))
        if key and key not in out:
            out[key] = (q, k)
    return list(out.values())


def loose_json(text: str) -> dict:
    """The object in a model's reply: in a fence, or from the first brace on; what follows it doesn't matter."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.DOTALL | re.IGNORECASE)
    body = fenced[1] if fenced else text
    start = body.find("{")
    if start < 0:
        raise ValueError("no JSON object in the reply")
    value, _ = json.JSONDecoder().raw_decode(body[start:])
    return value


def clamped(value: object, cap: int) -> int:
    """A setting: no integer or less than 1 gives the default, which is the cap; more gives the cap."""
    try:
        n = int(str(value))
    except ValueError:
        return cap
    return cap if n < 1 or n > cap else n


def retrieval_limits(settings: Mapping[str, object]) -> dict[str, int]:
    """The bounds that a search really has: those of the settings, at most the defaults."""
    return {"search_limit": clamped(settings.get("search_limit"), 25), "max_candidate_parents": clamped(settings.get("max_candidate_parents"), 5), "final_parent_limit": 2}


def capabilities(provider: object) -> dict[str, bool]:
    """Which calls a provider offers."""
    return {name: callable(getattr(provider, name, None)) for name in CALLS}


def self_test(provider: Provider, dim: int) -> list[str]:
    """What is wrong with a provider, by one small call of each kind; nothing: an empty list."""
    wrong = []
    if np.asarray(provider.embed(["ping", "pong"])).shape != (2, dim):
        wrong.append("embed: shape")
    if not set(provider.rerank("ping", [{"parent_id": "a", "question": "ping", "section_heading": "", "body_preview": ""}])) <= {"a"}:
        wrong.append("rerank: unknown parent")
    if len(provider.questions("One thing is so. Another is not.", 2)) > 2:
        wrong.append("questions: more than asked for")
    if not isinstance(provider.answer("ping", [("[a]", "It pings.")], []), str):
        wrong.append("answer: no text")
    return wrong


def checked_questions(pairs: object, n: int) -> list[tuple[str, str]]:
    """A reply to a request for n questions: a list of at most n of (question, key knowledge), once each, none blank."""
    if not isinstance(pairs, list) or len(pairs) > n:
        raise ValueError("questions must be a list of no more than were asked for")
    return dedup_questions([(str(q).strip(), str(k)) for q, k in pairs if str(q).strip()])


def make_provider(name: str, **settings: object) -> Provider:
    """A provider by name: ``offline``, or any that was put into ``FACTORIES``."""
    if name not in FACTORIES:
        raise ValueError(f"no provider {name}")
    return FACTORIES[name](**settings)


CALLS = ("embed", "rerank", "questions", "answer", "plan", "graph", "verify", "teach_step", "external_scores")
FACTORIES: dict[str, Callable[..., Provider]] = {"offline": OfflineProvider}
