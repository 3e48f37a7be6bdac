"""Operations by name: what a tool or a job may run, with typed parameters."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import archive_state, index, quality, retrieval

#: Parts of a parameter's name that tell a secret, which is never written down.
SECRET = ("key", "token", "password", "secret")


@dataclass(frozen=True)
class Operation:
    """A run over tables: its name, what it does, its function, its parameters with their types and defaults."""

    name: str
    about: str
    run: Callable[..., DataFrame]
    params: dict[str, tuple[type, object]] = field(default_factory=dict)

    def checked(self, given: dict[str, object]) -> dict[str, object]:
        """All parameters, the given ones in their types; unknown ones and wrong types are errors."""
        unknown = set(given) - set(self.params)
        if unknown:
            raise ValueError(f"{self.name}: unknown parameter {min(unknown)}")
        out = {}
        for name, (kind, default) in self.params.items():
            value = given.get(name, default)
            if value is not None and (not isinstance(value, kind) or isinstance(value, bool) and kind is not bool):
                raise ValueError(f"{self.name}: {name} must be {kind.__name__}")
            out[name] = value
        return out

    def serialized(self, given: dict[str, object]) -> str:
        """The parameters as they are kept with a run; secrets are refused."""
        for name in given:
            if any(part in name.lower() for part in SECRET):
                raise ValueError(f"{self.name}: {name} isn't written down")
        return json.dumps(self.checked(given), ensure_ascii=False, sort_keys=True)


def _page(pages: DataFrame, source: str, page: int) -> DataFrame:
    wanted = pages.sparkSession.createDataFrame([(source, page)], "source string, page int")
    return archive_state.reply_for(wanted, pages)


OPERATIONS: dict[str, Operation] = {
    o.name: o
    for o in (
        Operation("normalize", "Clean texts, and tell which changed.", lambda texts: index.normalized(texts)),
        Operation("quality", "Score texts.", lambda texts: quality.page_scored(texts)),
        Operation("worst", "The lowest scores.", lambda scores, limit: quality.worst(scores, "score", ["pdf_stem", "page_num"], limit), {"limit": (int, 20)}),
        Operation("histogram", "How many scores lie in each tenth.", lambda scores: quality.histogram(scores, "score")),
        Operation("search_archive", "Full-text search.", lambda texts, query, top_k: retrieval.bm25(texts, "doc_id", "text", query, retrieval.limits(top_k, None)[0]), {"query": (str, ""), "top_k": (int, None)}),
        Operation("search_fuzzy", "Typo-tolerant search.", lambda texts, query, limit, threshold: retrieval.fuzzy(texts, "doc_id", "text", query, limit, threshold), {"query": (str, ""), "limit": (int, 20), "threshold": (float, 0.8)}),
        Operation("get_page", "One page of a document.", _page, {"source": (str, ""), "page": (int, 1)}),
        Operation("sources", "The documents whose name holds a text.", lambda files, query: files.where(F.lower("pdf_stem").contains(query.lower())).select("pdf_stem"), {"query": (str, "")}),
    )
}


def run(name: str, *tables: DataFrame, **given: object) -> DataFrame:
    """Run an operation by its name over its tables."""
    if name not in OPERATIONS:
        raise KeyError(f"unknown operation {name!r}")
    o = OPERATIONS[name]
    return o.run(*tables, **o.checked(given))
