"""User layers: own scanners and tables, tags, audits and report blocks (UDF-01..06, FRM-16)."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnloom.operators.reliability import require

#: Section keys in their default order, and what an audited table must carry.
SECTIONS = ["eval_setup", "phase_timeline", "interventions", "token_telemetry", "subagents", "token_spend", "target_conversation", "phase_cards"]
AUDITED = ["confidence", "judge_agreement", "label_source", "members"]
#: Blocks, the columns each needs, and which of them must be numbers.
BLOCKS = {
    "turn_chart": (["transcript_id", "turn", "y"], ["y"]),
    "turn_band": (["transcript_id", "turn", "label"], []),
    "span_lanes": (["transcript_id", "start", "end", "label"], ["start", "end"]),
    "event_marks": (["transcript_id", "turn", "label"], []),
    "table": ([], []),
}


@dataclass
class Layer:
    """A named extension: a scanner (or its factory), a table or a function of raw results, and what is done with it."""

    name: str
    scanner: Callable | None = None
    frame: DataFrame | Callable[[DataFrame], DataFrame] | None = None
    blocks: list[tuple[str, dict[str, str]]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    audit: str | None = None
    scanner_args: dict = field(default_factory=dict)


def validate(layers: list[Layer], builtin: list[str]) -> None:
    """UDF-01: names are unique and not built in; a layer has a source; tags, audits and blocks need a table."""
    seen: set[str] = set()
    for x in layers:
        if not x.name.isidentifier():
            raise ValueError(f"layer {x.name!r}: a name must be an identifier")
        if x.name in seen or x.name in builtin or x.name in SECTIONS:
            raise ValueError(f"layer {x.name!r}: the name is taken")
        seen.add(x.name)
        if x.scanner is None and x.frame is None:
            raise ValueError(f"layer {x.name!r}: it needs a scanner or a frame")
        if x.scanner_args and x.scanner is None:
            raise ValueError(f"layer {x.name!r}: scanner_args without a scanner")
        if len(set(x.tags)) < len(x.tags):
            raise ValueError(f"layer {x.name!r}: a tag is named twice")
        for kind, _ in x.blocks:
            if kind not in BLOCKS:
                raise ValueError(f"layer {x.name!r}: no block {kind!r}; there are {sorted(BLOCKS)}")


def inject(layers: list[Layer], judge_args: dict, spec: dict) -> list[Layer]:
    """UDF-02: scanner factories get the judge arguments and the spec that their signatures name; a layer can't shadow them."""
    known, out = judge_args | {"spec": spec}, []
    for x in layers:
        if x.scanner is None:
            out.append(x)
            continue
        if shadowed := sorted(set(x.scanner_args) & set(known)):
            raise ValueError(f"layer {x.name!r}: {shadowed} are set for all layers")
        named = inspect.signature(x.scanner).parameters
        args = {k: v for k, v in known.items() if k in named} | x.scanner_args
        out.append(replace(x, scanner=x.scanner(**args), scanner_args={}))
    return out


def table(layer: Layer, raw: DataFrame | None) -> DataFrame:
    """FRM-16: the layer's table: a ready one, a function of raw results, or those themselves. An empty one that is shown is an error."""
    if isinstance(layer.frame, DataFrame):
        out = layer.frame
    elif raw is None:
        raise ValueError(f"layer {layer.name!r}: its scanner left no results")
    else:
        out = layer.frame(raw) if layer.frame else raw
    if layer.blocks and not out.limit(1).count():
        raise ValueError(f"layer {layer.name!r}: there are no rows to show")
    check(layer, out)
    return out


def check(layer: Layer, frame: DataFrame) -> None:
    """UDF-03, UDF-04: the columns that audits and blocks need, and numbers where numbers are drawn."""
    if layer.audit:
        require(frame, [*AUDITED, layer.audit], f"layer {layer.name!r} is audited")
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    for kind, columns in layer.blocks:
        needs, numbers = BLOCKS[kind]
        require(frame, [columns.get(c, c) for c in needs], f"block {kind} of layer {layer.name!r}")
        for c in numbers:
            if not isinstance(kinds[columns.get(c, c)], T.NumericType):
                raise ValueError(f"block {kind} of layer {layer.name!r}: {columns.get(c, c)} must be a number")


def section_order(order: list[str] | None, layers: list[Layer]) -> list[str]:
    """UDF-06: the keys asked for first, the others as they are; unknown and repeated ones are refused."""
    default = [*SECTIONS, *(x.name for x in layers)]
    order = order or []
    if bad := sorted(set(order) - set(default)):
        raise ValueError(f"no section {bad}; there are {default}")
    if len(set(order)) < len(order):
        raise ValueError("a section is named twice")
    return [*order, *(k for k in default if k not in order)]
