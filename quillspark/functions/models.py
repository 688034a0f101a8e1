"""Models behind small interfaces, each with a deterministic offline stand-in."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Vectors of texts, a batch at a time."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Hashed character trigrams, unit length (the first axis for an empty text)."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            codes = np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
            h = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
            h ^= h >> np.uint64(29)
            np.add.at(out[i], (h % np.uint64(self.dim)).astype(int), np.where(h & np.uint64(1 << 40), 1.0, -1.0))
            if not out[i].any():
                out[i, 0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def embedded(text: Column, model: Embedder | None = None) -> Column:
    """array<double> of every text; null for null."""
    model = model or HashEmbedder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        some = x.notna()
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        if some.any():
            out[some] = pd.Series(list(model.embed(x[some].tolist())), index=x.index[some])
        return out

    return run(text)


class Generator(Protocol):
    """Answers to (system message, question) pairs, a batch at a time."""

    def generate(self, systems: list[str], questions: list[str]) -> list[str]: ...


class FirstSource:
    """Offline stand-in: the first source's first line answers."""

    def generate(self, systems: list[str], questions: list[str]) -> list[str]:
        def one(system: str) -> str:
            lines = system.partition("Context:\n")[2].split("\n")
            return next((x.strip() for x in lines[1:] if x.strip()), "")

        return [one(s) for s in systems]


def generated(system: Column, question: Column, model: Generator | None = None) -> Column:
    """The model's answers; null where the system message is null (no call is made)."""
    model = model or FirstSource()

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series, q: pd.Series) -> pd.Series:
        some = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        if some.any():
            out[some] = model.generate(s[some].tolist(), q[some].fillna("").tolist())
        return out

    return run(system, question)


class Tracker(Protocol):
    """Tracks (id and boxes) of a segment's frames."""

    def track(self, frames: list[dict]) -> list[dict]: ...


class Vision(Protocol):
    """A reply about frames for a prompt."""

    def describe(self, frames: list[dict], prompt: str) -> str: ...


class Deblurrer(Protocol):
    """A frame made sharper."""

    def sharpen(self, frame: dict) -> dict: ...


class NoTracker:
    def track(self, frames: list[dict]) -> list[dict]:
        return []


class NoVision:
    def describe(self, frames: list[dict], prompt: str) -> str:
        return ""


class NoDeblurrer:
    def sharpen(self, frame: dict) -> dict:
        return frame


#: Stand-ins that do nothing, for names that are unknown or can't be made.
NOTHING: dict[str, Callable[[], object]] = {"tracker": NoTracker, "vision": NoVision, "deblurrer": NoDeblurrer}


def made(kind: str, name: str | None, known: dict[str, Callable[[], object]]) -> object:
    """The backend of that name, else (unknown, or it can't be made) the one that does nothing."""
    try:
        return known[name or ""]()
    except Exception:
        return NOTHING[kind]()


# Keys that stand for none.
NO_KEYS = ["", "sk-dummy-key", "dummy", "placeholder", "none"]


def model_catalogue(fetch: Callable[[str | None], list[dict]], key: str | None = None) -> tuple[list[dict], str | None]:
    """(models, error) of a server.  ``fetch`` is called with the key, or None for placeholder
    keys; where it says 401 it is asked again without one."""
    own = (key or "").strip()
    use = None if own.lower() in NO_KEYS else own
    for attempt in ([use, None] if use else [None]):
        try:
            return fetch(attempt), None
        except Exception as e:
            error = str(e)
            if "401" not in error:
                break
    return [], error


class Chat(Protocol):
    """One turn of a conversation: the names and arguments of tools to call, or an answer."""

    def turn(self, messages: list[dict], tools: list[str]) -> dict: ...


def react(model: Chat, tools: dict[str, Callable[[str], str]], question: str, most: int = 10) -> list[dict]:
    """Messages of a loop of model and tools, until the model calls none; more than ``most`` turns are an error.
    An unknown tool's reply says so."""
    messages = [{"role": "user", "content": question}]
    for _ in range(most):
        reply = model.turn(messages, sorted(tools))
        messages.append({"role": "assistant", **reply})
        if not reply.get("calls"):
            return messages
        for name, argument in reply["calls"]:
            messages.append({"role": "tool", "name": name, "content": tools[name](argument) if name in tools else f"unknown tool: {name}"})
    raise RuntimeError(f"no answer after {most} turns")


def bound_tools(factories: dict[str, Callable[[int, int], Callable[[str], str]]], agent_id: int, user_id: int, names: list[str]) -> dict[str, Callable[[str], str]]:
    """Tools of one agent and user, made by their factories; unknown names are left out."""
    return {n: factories[n](agent_id, user_id) for n in names if n in factories}


class ToolServer(Protocol):
    """A remote server's tools: their names, and a call from string to string."""

    def names(self) -> list[str]: ...

    def call(self, name: str, argument: str) -> str: ...


def discovered(servers: list[ToolServer]) -> dict[str, Callable[[str], str]]:
    """Tools of all servers by name (the first of equal names); a server that can't be reached has none,
    and a call that fails answers with its error."""
    out: dict[str, Callable[[str], str]] = {}
    for server in servers:
        try:
            names = server.names()
        except Exception:
            continue
        for name in names:
            def call(argument: str, server: ToolServer = server, name: str = name) -> str:
                try:
                    return server.call(name, argument)
                except Exception as e:
                    return f"error: {e}"

            out.setdefault(name, call)
    return out


class Tools:
    """Functions by name: columns to a column.  Unknown names are left out."""

    def __init__(self, known: dict[str, Callable[..., Column]]):
        self.known = known

    def chosen(self, names: list[str]) -> dict[str, Callable[..., Column]]:
        return {n: self.known[n] for n in names if n in self.known}

    def register(self, spark: SparkSession, udfs: dict[str, object]) -> None:
        """Makes Python functions (pandas UDFs) callable from SQL under their names."""
        for name, f in udfs.items():
            spark.udf.register(name, f)
