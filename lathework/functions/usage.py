"""Usage, cost and tool calls out of JSON text, through VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lathework.functions.coerce import _col

# The key names under which records hold tokens, tool calls and money, first to last resort.
INPUT = ("input_tokens", "prompt_tokens", "input_token_count", "prompt_token_count")
OUTPUT = ("output_tokens", "completion_tokens", "output_token_count", "completion_token_count")
TOTAL = ("total_tokens", "total_token_count")
CACHED = ("cached_input_tokens", "input_cached_tokens", "cached_prompt_tokens")
CACHED_IN = ("input_tokens_details", "prompt_tokens_details")
CALLS = ("tool_calls", "tool_call_count", "total_tool_calls", "num_tool_calls")
COST = ("total_cost_usd", "total_cost", "usd", "value", "amount", "total_usd")
COST_PARTS = (
    "input_cost", "output_cost", "cached_input_cost", "cache_read_cost", "cache_creation_cost", "cache_write_cost",
    "cache_write_5m_cost", "cache_write_1h_cost", "tool_cost", "server_tool_cost",
)
# The types of events that call a tool, by where the type stands.
CALL_TYPES = ("tool_call", "function_call", "tool_use")
STARTED_TYPES = ("command_execution", "function_call", "tool_call")
ADDED_TYPES = ("function_call", "tool_call")
BLOCK_TYPES = ("tool_use", "server_tool_use", "tool_call", "function_call")


def parsed(c: Column | str) -> Column:
    """A JSON text as VARIANT; a text that is a JSON string stands for the JSON in it."""
    v = F.try_parse_json(_col(c))
    inner = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(inner)).otherwise(v)


def pick(v: Column, keys: Sequence[str], of: str = "bigint") -> Column:
    """The first key that is there and fits the type."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", of) for k in keys])


def mapping(v: Column) -> Column:
    """The VARIANT where it is an object with a key, else null."""
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT") & (kind != "OBJECT<>"), v)


def within(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def telemetry(metadata: Column) -> Column:
    """The events of a record's metadata that are objects."""
    events_ = F.coalesce(F.try_variant_get(metadata, "$.telemetry", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(events_, lambda e: F.schema_of_variant(e).startswith("OBJECT"))


def _least(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))


def _total(events_: Column, path: str) -> Column:
    return F.aggregate(events_, F.lit(0).cast("bigint"), lambda s, e: s + _least(F.try_variant_get(e, f"$.part.tokens.{path}", "bigint")))


def stated(usage: Column, metadata: Column) -> Column:
    """The first usage that a record states: its own, its metadata's, or an event's or an event part's."""
    from_events = F.filter(F.flatten(F.transform(telemetry(metadata), lambda e: F.array(mapping(within(e, "usage")), mapping(within(e, "part.usage"))))), lambda v: v.isNotNull())
    return F.coalesce(mapping(usage), mapping(within(metadata, "usage")), F.try_element_at(from_events, F.lit(1)))


def cached(v: Column) -> Column:
    return F.coalesce(pick(v, CACHED), *[F.try_variant_get(v, f"$.{k}.cached_tokens", "bigint") for k in CACHED_IN])


def tokens(v: Column) -> Column:
    """struct<input, output, total, cached> of a usage; the total falls back to the sum."""
    i, o = _least(pick(v, INPUT)), _least(pick(v, OUTPUT))
    total = pick(v, TOTAL)
    return F.struct(i.alias("input"), o.alias("output"), F.when(total.isNotNull(), _least(total)).otherwise(i + o).alias("total"), _least(cached(v)).alias("cached"))


def record_tokens(usage: Column, metadata: Column) -> Column:
    """struct<input, output, total, cached> of a record: of what it states, else the sums over its events' tokens."""
    said = stated(usage, metadata)
    events_ = telemetry(metadata)
    read, plain, out, total = _total(events_, "cache.read"), _total(events_, "input"), _total(events_, "output"), _total(events_, "total")
    summed = F.struct((plain + read).alias("input"), out.alias("output"), F.when(total > 0, total).otherwise(plain + read + out).alias("total"), read.alias("cached"))
    return F.when(said.isNotNull(), tokens(said)).otherwise(summed)


def events(raw: Column | str) -> Column:
    """The lines of a JSON-lines output that parse, as VARIANTs."""
    return F.filter(F.transform(F.split(F.coalesce(_col(raw), F.lit("")), "\n"), lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())


def event_calls(v: Column) -> Column:
    """How many calls of a tool one event stands for."""
    text = lambda p: F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))
    blocks = F.coalesce(F.try_variant_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    in_blocks = F.size(F.filter(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string").isin(*BLOCK_TYPES), F.lit(False))))
    one = text("$.type").isin(*CALL_TYPES) | ((text("$.type") == "item.started") & text("$.item.type").isin(*STARTED_TYPES)) | ((text("$.type") == "response.output_item.added") & text("$.item.type").isin(*ADDED_TYPES))
    return F.when(one, 1).otherwise(in_blocks)


def _calls(list_: Column) -> Column:
    return F.aggregate(list_, F.lit(0), lambda s, e: s + event_calls(e))


def tool_calls(raw: Column | str) -> Column:
    """How many calls of a tool the events of an output stand for."""
    return _calls(events(raw))


def stated_calls(v: Column) -> Column:
    number, listed = pick(v, CALLS), F.try_variant_get(v, "$.tool_calls", "array<variant>")
    return F.coalesce(F.when(number.isNotNull(), _least(number)), F.when(listed.isNotNull(), F.size(listed)).cast("bigint"))


def record_calls(usage: Column, metadata: Column, raw: Column) -> Column:
    """Tool calls of a record: stated by its usage or its metadata, else those of its events, else those of its output."""
    count = lambda c: F.when(c > 0, c)
    listed = F.when(F.schema_of_variant(metadata).startswith("OBJECT"), metadata)
    return F.coalesce(stated_calls(stated(usage, metadata)), stated_calls(listed), count(_calls(telemetry(metadata))).cast("bigint"), tool_calls(raw).cast("bigint"), F.lit(0))


def _positive(v: Column, key: str) -> Column:
    d = F.try_variant_get(v, f"$.{key}", "double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (d > 0), d)


def cost(v: Column) -> Column:
    """Money in a cost record: the first positive total, else the sum of its parts where that is positive."""
    parts = sum((F.coalesce(_positive(v, k), F.lit(0.0)) for k in COST_PARTS), F.lit(0.0))
    return F.coalesce(*[_positive(v, k) for k in COST], F.when(parts > 0, parts))


def record_cost(cost_: Column, metadata: Column) -> Column:
    """Money of a record: its own cost, its metadata's, else the sum over its events (an event's, else its part's)."""
    each = lambda e: F.coalesce(cost(within(e, "cost")), _positive(e, "cost"), cost(within(e, "part.cost")), _positive(e, "part.cost"), F.lit(0.0))
    from_events = F.aggregate(telemetry(metadata), F.lit(0.0), lambda s, e: s + each(e))
    return F.coalesce(cost(cost_), cost(within(metadata, "cost")), F.when(from_events > 0, from_events))


def event_error(metadata: Column) -> Column:
    """The message (or name) of the first event error that says anything."""
    said = F.transform(telemetry(metadata), lambda e: F.coalesce(F.nullif(F.try_variant_get(e, "$.error.data.message", "string"), F.lit("")), F.nullif(F.try_variant_get(e, "$.error.name", "string"), F.lit(""))))
    return F.try_element_at(F.filter(said, lambda s: s.isNotNull() & (F.trim(s) != "")), F.lit(1))


def error_only(raw: Column | str) -> Column:
    lines = F.filter(F.split(F.coalesce(_col(raw), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: F.coalesce(F.lower(F.try_variant_get(F.try_parse_json(x), "$.type", "string")) == "error", F.lit(False)))


def last_message(raw: Column | str) -> Column:
    """The text of the last message of a JSON-lines output."""
    said = F.filter(events(raw), lambda v: F.try_variant_get(v, "$.type", "string") == "message")
    return F.try_variant_get(F.try_element_at(said, F.lit(-1)), "$.text", "string")
