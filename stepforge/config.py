"""Curricula as typed settings read from JSON; nothing of a settings file is executed."""

from __future__ import annotations

import json
import re
import types
from dataclasses import MISSING, dataclass, fields
from pathlib import Path
from typing import Any, Union, get_args, get_origin, get_type_hints

# How run folders begin.
_DATED = re.compile(r"^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Curriculum:
    """One stage: where its rows lie, which models it uses, and how many rows it takes (None: all)."""

    dataset: str
    base_model: str
    tokenizer: str | None = None
    name: str | None = None
    models: tuple[int, ...] = ()
    num_train_samples: int | None = None
    num_eval_samples: int | None = None
    behavior_cloning: bool = False

    @property
    def tokenizer_name(self) -> str:
        return self.tokenizer or self.base_model


@dataclass(frozen=True)
class Curricula:
    train: tuple[Curriculum, ...]
    test: tuple[Curriculum, ...] = ()
    datasets: tuple[str, ...] = ()
    name: str = ""
    output_dir: str | None = None
    retrieval_k: int = 3
    prototype_size: int = 15

    def __post_init__(self) -> None:
        for stage in (*self.train, *self.test):
            if bad := [m for m in stage.models if not 0 <= m < len(self.datasets)]:
                raise ValueError(f"models without a dataset: {bad}")
            for n in (stage.num_train_samples, stage.num_eval_samples):
                if n is not None and n < 0:
                    raise ValueError(f"a negative number of samples: {n}")
        if self.prototype_size < 1 or self.retrieval_k < 1:
            raise ValueError("prototype_size and retrieval_k must be positive")


def _value(kind: Any, x: Any, where: str) -> Any:
    if get_origin(kind) in (Union, types.UnionType):
        return None if x is None else _value(next(k for k in get_args(kind) if k is not type(None)), x, where)
    if get_origin(kind) is tuple:
        if not isinstance(x, list):
            raise ValueError(f"{where}: a list is needed")
        return tuple(_value(get_args(kind)[0], e, f"{where}[{i}]") for i, e in enumerate(x))
    if kind in (Curriculum, Curricula):
        return _made(kind, x, where)
    if not isinstance(x, kind) or (kind is int and isinstance(x, bool)):
        raise ValueError(f"{where}: {kind.__name__} is needed, not {x!r}")
    return x


def _made(kind: type, x: Any, where: str) -> Any:
    if not isinstance(x, dict):
        raise ValueError(f"{where}: an object is needed")
    kinds, known = get_type_hints(kind), {f.name for f in fields(kind)}
    needed = {f.name for f in fields(kind) if f.default is MISSING and f.default_factory is MISSING}
    if wrong := sorted(set(x) - known):
        raise ValueError(f"{where}: unknown settings {wrong}")
    if lacks := sorted(needed - set(x)):
        raise ValueError(f"{where}: missing settings {lacks}")
    return kind(**{k: _value(kinds[k], v, f"{where}.{k}") for k, v in x.items()})


def load_curricula(path: str | Path) -> Curricula:
    """Settings of a JSON file. A name that is empty or a mere time becomes that of the file's folder, which is also where output goes if nothing else is said."""
    path = Path(path)
    found = json.loads(path.read_text())
    if isinstance(found, dict):
        if not found.get("name") or (isinstance(found["name"], str) and _DATED.match(found["name"])):
            found["name"] = path.parent.name
        found.setdefault("output_dir", str(path.parent.parent))
    return _made(Curricula, found, path.name)
