"""Completions, providers and accounting.

Provider routing, option resolution, validation, payloads, error messages and
reply normalisation are column expressions over request tables. The provider
registry is configuration (a handful of rows), joined with a checked
broadcast. Actual model calls are a user-supplied function run per Arrow
batch with ``mapInPandas``; failures become error columns, not failed tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.ledger import AnswerLedger
from quire.plans.joins import checked_broadcast, literal_frame

# Defaults of the provider settings, the mock provider's reply
# and model, the gateway's model rule and the error message texts.
DEFAULT_PROVIDER = "ollama"
DEFAULT_MODEL = "llama3.2"
DEFAULT_HOST = "http://localhost:11434"
DEFAULT_TEMPERATURE = 0.7
DEFAULT_MAX_TOKENS = 2048
DEFAULT_TIMEOUT = 120
TEMPERATURE_RANGE = (0.0, 2.0)
MOCK_RESPONSE = "This is a mock response from the LLM."
MOCK_MODEL = "mock/model"
GATEWAY = "litellm"
LOCAL_PROVIDER = "ollama"
ROLE_USER = "user"
GATEWAY_MODEL_HINT = "model (must include provider prefix, e.g., 'openai/gpt-4')"
NOT_CONFIGURED = "LLM provider not configured"
# Error message templates (%s = provider name, field list, URL,
# status, body) and the prefix put in front of a message when the provider is known.
PROVIDER_PREFIX_TEMPLATE = "[%s] "
NOT_FOUND_TEMPLATE = "Provider '%s' not found"
AVAILABLE_TEMPLATE = ". Available: %s"
BAD_CONFIG_TEMPLATE = "Invalid configuration for provider '%s'"
MISSING_FIELDS_TEMPLATE = ". Missing fields: %s"
COMPLETION_FAILED_TEMPLATE = "Completion failed: %s"
CONNECTION_FAILED = "Connection failed"
CONNECTION_URL_TEMPLATE = " to %s"
HTTP_ERROR_TEMPLATE = "HTTP %s: %s"
LIST_SEPARATOR = ", "

# The providers there are by default, in registration order, with the default settings
# (provider, model, temperature, max_tokens, timeout, host).
DEFAULT_PROVIDER_CONFIG = [
    (name, DEFAULT_MODEL, DEFAULT_TEMPERATURE, DEFAULT_MAX_TOKENS, DEFAULT_TIMEOUT, host)
    for name, host in ((LOCAL_PROVIDER, DEFAULT_HOST), (GATEWAY, None), ("mock", None))
]
CONFIG_SCHEMA = "provider string, model string, temperature double, max_tokens int, timeout int, host string"


@dataclass
class ProviderRegistry:
    """Names and settings of the registered providers (lower-cased names, registration order)."""

    rows: list[tuple]

    @classmethod
    def default(cls) -> "ProviderRegistry":
        return cls(list(DEFAULT_PROVIDER_CONFIG))

    def register(self, name: str, model: str | None = None, temperature: float | None = None,
                 max_tokens: int | None = None, timeout: int | None = None, host: str | None = None) -> None:
        """Add or replace a provider; an explicit registration wins over a default one."""
        name = name.lower()
        row = (name, model, temperature, max_tokens, timeout, host)
        self.rows = [r for r in self.rows if r[0] != name] + [row]

    @property
    def names(self) -> list[str]:
        return [r[0] for r in self.rows]

    def frame(self, spark: SparkSession) -> DataFrame:
        return literal_frame(spark, self.rows, CONFIG_SCHEMA)


# --- error texts (L14) ---

def _with_provider(provider: Column, message: Column) -> Column:
    """Message prefixed with the provider name when one is known."""
    known = provider.isNotNull() & (provider != "")
    return F.when(known, F.concat(F.format_string(PROVIDER_PREFIX_TEMPLATE, provider), message)).otherwise(message)


def _listed(template: str, items: list[str] | None) -> Column:
    return F.lit(template % LIST_SEPARATOR.join(items)) if items else F.lit("")


def not_found_message(name: Column, available: list[str]) -> Column:
    msg = F.concat(F.format_string(NOT_FOUND_TEMPLATE, name), _listed(AVAILABLE_TEMPLATE, available))
    return _with_provider(name, msg)


def configuration_message(provider: Column, missing: list[str] | None = None) -> Column:
    msg = F.concat(F.format_string(BAD_CONFIG_TEMPLATE, provider), _listed(MISSING_FIELDS_TEMPLATE, missing))
    return _with_provider(provider, msg)


def completion_failed_message(provider: Column, message: Column) -> Column:
    return _with_provider(provider, F.format_string(COMPLETION_FAILED_TEMPLATE, message))


def http_error_text(status: Column, body: Column) -> Column:
    return F.format_string(HTTP_ERROR_TEMPLATE, status.cast("string"), body)


def connection_failed_message(provider: Column, url: Column) -> Column:
    suffix = F.when(url.isNotNull() & (url != ""), F.format_string(CONNECTION_URL_TEMPLATE, url)).otherwise(F.lit(""))
    return _with_provider(provider, F.concat(F.lit(CONNECTION_FAILED), suffix))


# --- mock completion (L7, L8) ---

def mock_complete(df: DataFrame, prompt: Column, override: Column | None = None,
                  model: str = MOCK_MODEL) -> DataFrame:
    """Deterministic completion: fixed (or overridden) text, whitespace-token usage."""
    content = F.coalesce(override, F.lit(MOCK_RESPONSE)) if override is not None else F.lit(MOCK_RESPONSE)
    return (df.withColumn("content", content)
            .withColumn("model", F.lit(model))
            .withColumn("prompt_tokens", T.token_count(prompt))
            .withColumn("completion_tokens", T.token_count(F.col("content"))))


def conversation_usage(conversations: DataFrame) -> DataFrame:
    """A4 + O4 per conversation: summed message tokens and the last user message ('' if none).

    Both are partial aggregates, so a very long conversation is combined
    map-side rather than gathered in one task.
    """
    return conversations.groupBy("conv_id").agg(
        F.sum(T.token_count("text")).alias("prompt_tokens"),
        F.coalesce(F.max_by(F.col("text"), F.when(F.col("role") == ROLE_USER, F.col("turn"))), F.lit(""))
        .alias("last_user"))


def mock_chat(conversations: DataFrame, documents: DataFrame, override: Column | None = None,
              model: str = MOCK_MODEL) -> DataFrame:
    """L8 on chats about a document: the system message (context + document text) counts too.

    A conversation whose document isn't there gets an ``error`` row without content or counts.
    """
    from quire.operators.prompts import NO_DOCUMENT, chat_context

    usage = conversation_usage(conversations)
    docs = documents.select(F.col("doc_id").alias("conv_id"),
                            T.token_count(chat_context(F.col("text"))).alias("system_tokens"))
    content = F.coalesce(override, F.lit(MOCK_RESPONSE)) if override is not None else F.lit(MOCK_RESPONSE)
    known = F.col("system_tokens").isNotNull()
    return usage.join(docs, "conv_id", "left").select(
        "conv_id", F.when(known, content).alias("content"), F.when(known, F.lit(model)).alias("model"),
        (F.col("prompt_tokens") + F.col("system_tokens")).alias("prompt_tokens"),
        F.when(known, T.token_count(content)).alias("completion_tokens"), "last_user",
        F.when(~known, F.lit(NO_DOCUMENT)).alias("error"))


# --- routing and options (L9-L12) ---

def route_provider(requests: DataFrame, registry: ProviderRegistry, provider: str = "provider") -> DataFrame:
    """Case-insensitive registry lookup. Adds the registered name (or NULL), the
    provider settings as ``cfg_*`` columns and an ``error`` for unknown or missing names."""
    cfg = registry.frame(requests.sparkSession).select(
        F.col("provider").alias("_registered"), *[F.col(c).alias("cfg_" + c) for c in
                                                  ("model", "temperature", "max_tokens", "timeout", "host")])
    cfg = checked_broadcast(cfg, max_rows=10_000, known_rows=len(registry.rows))
    asked = F.lower(F.col(provider))
    joined = requests.join(cfg, asked == F.col("_registered"), "left")
    error = (F.when(F.col(provider).isNull(), F.lit(NOT_CONFIGURED))
             .when(F.col("_registered").isNull(), not_found_message(asked, registry.names)))
    return joined.withColumn("route_error", error).withColumnRenamed("_registered", "registered_provider")


def resolve_model(provider: Column, provider_models: dict[str, str], default_model: str = DEFAULT_MODEL) -> Column:
    """``provider_models.get(provider, model)`` (exact, case-sensitive key)."""
    if not provider_models:
        return F.lit(default_model)
    mapping = F.create_map(*[x for kv in provider_models.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.try_element_at(mapping, provider), F.lit(default_model))


def resolve_options(routed: DataFrame) -> DataFrame:
    """Per-call value, else the provider's setting, else the global default."""
    return (routed
            .withColumn("eff_model", F.coalesce(F.col("model"), F.col("cfg_model"), F.lit(DEFAULT_MODEL)))
            .withColumn("eff_temperature", F.coalesce(F.col("temperature").cast("double"),
                                                      F.col("cfg_temperature"), F.lit(DEFAULT_TEMPERATURE)))
            .withColumn("eff_max_tokens", F.coalesce(F.col("max_tokens").cast("bigint"),
                                                     F.col("cfg_max_tokens").cast("bigint"),
                                                     F.lit(DEFAULT_MAX_TOKENS).cast("bigint")))
            .withColumn("eff_timeout", F.coalesce(F.col("timeout").cast("bigint"), F.col("cfg_timeout").cast("bigint"),
                                                  F.lit(DEFAULT_TIMEOUT).cast("bigint"))))


def gateway_model_ok(model: Column) -> Column:
    return F.coalesce((model != "") & F.contains(model, F.lit("/")), F.lit(False))


def option_violations(provider: Column, model: Column, temperature: Column, max_tokens: Column,
                      timeout: Column) -> Column:
    """Comma-joined names of the violated rules ('' when valid)."""
    lo, hi = TEMPERATURE_RANGE
    return F.concat_ws(
        ",",
        F.when((temperature < lo) | (temperature > hi), F.lit("temperature")),
        F.when(max_tokens <= 0, F.lit("max_tokens")),
        F.when(timeout <= 0, F.lit("timeout")),
        F.when((provider == GATEWAY) & ~gateway_model_ok(model), F.lit("model")))


# --- payloads (L13) ---

def request_payload(provider: Column, model: Column, prompt: Column, temperature: Column,
                    max_tokens: Column, timeout: Column) -> Column:
    """JSON body sent to the local server or to the gateway (NULL for other providers)."""
    local = F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), F.lit(False).alias("stream"),
                               F.struct(temperature.alias("temperature"),
                                        max_tokens.alias("num_predict")).alias("options")))
    gateway = F.to_json(F.struct(model.alias("model"),
                                 F.array(F.struct(F.lit(ROLE_USER).alias("role"), prompt.alias("content")))
                                 .alias("messages"),
                                 temperature.alias("temperature"), max_tokens.alias("max_tokens"),
                                 timeout.alias("timeout")))
    return F.when(provider == LOCAL_PROVIDER, local).when(provider == GATEWAY, gateway)


def chat_payload(provider: Column, model: Column, messages: Column, temperature: Column,
                 max_tokens: Column, timeout: Column) -> Column:
    """JSON body of a chat request: the message list (role, content) with the same options as a completion."""
    local = F.to_json(F.struct(model.alias("model"), messages.alias("messages"), F.lit(False).alias("stream"),
                               F.struct(temperature.alias("temperature"),
                                        max_tokens.alias("num_predict")).alias("options")))
    gateway = F.to_json(F.struct(model.alias("model"), messages.alias("messages"), temperature.alias("temperature"),
                                 max_tokens.alias("max_tokens"), timeout.alias("timeout")))
    return F.when(provider == LOCAL_PROVIDER, local).when(provider == GATEWAY, gateway)


# The local server's completion and chat paths.
LOCAL_COMPLETE_PATH = "/api/generate"
LOCAL_CHAT_PATH = "/api/chat"


def endpoint_url(provider: Column, host: Column, chat: bool = False) -> Column:
    """Where a local-server request goes: the host without trailing '/' plus the API path (NULL otherwise)."""
    path = LOCAL_CHAT_PATH if chat else LOCAL_COMPLETE_PATH
    return F.when(provider == LOCAL_PROVIDER,
                  F.concat(T.rstrip_slashes(F.coalesce(host, F.lit(DEFAULT_HOST))), F.lit(path)))


PAYLOAD_SCHEMA = ("model string, prompt string, stream boolean, options struct<temperature: double, num_predict: "
                  "bigint>, messages array<struct<role: string, content: string>>, temperature double, "
                  "max_tokens bigint, timeout bigint")


def payload_fields(df: DataFrame, payload: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Read payloads back (parsed once): model, stream, temperature, num_predict, prompt length."""
    parsed = df.select(*keep, F.from_json(payload, PAYLOAD_SCHEMA).alias("_p"))
    j = F.col("_p")
    prompt = F.coalesce(j["prompt"], F.try_element_at(j["messages"], F.lit(1))["content"])
    return parsed.select(*keep, j["model"].alias("model"), j["stream"].alias("stream"),
                         F.coalesce(j["options"]["temperature"], j["temperature"]).alias("temperature"),
                         F.coalesce(j["options"]["num_predict"], j["max_tokens"]).alias("num_predict"),
                         F.length(prompt).cast("bigint").alias("prompt_length"))


def chat_payload_fields(df: DataFrame, payload: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Read chat payloads back (parsed once): the options, how many messages and how many characters they hold."""
    parsed = df.select(*keep, F.from_json(payload, PAYLOAD_SCHEMA).alias("_p"))
    j = F.col("_p")
    chars = F.aggregate(j["messages"], F.lit(0).cast("bigint"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    return parsed.select(*keep, j["model"].alias("model"), j["stream"].alias("stream"),
                         F.coalesce(j["options"]["temperature"], j["temperature"]).alias("temperature"),
                         F.coalesce(j["options"]["num_predict"], j["max_tokens"]).alias("num_predict"),
                         F.size(j["messages"]).cast("bigint").alias("n_messages"), chars.alias("n_chars"),
                         F.try_element_at(j["messages"], F.lit(1))["role"].alias("first_role"))


# --- reply normalisation (L15) and model lists (L17) ---

def normalize_replies(df: DataFrame, raw: str = "raw", shape: str = "shape", model: str | None = None,
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """The response record of each reply: content, model, prompt/completion/total tokens, raw_response, ``bad``.

    The reply is parsed once, in its own projection, and then read field by
    field: a field of another type is null and leaves the others as they are. A
    missing content or count has its default ('' or 0), a null one stays null
    (the gateway's null content is ''). Text that isn't a JSON object, or a null,
    is ``bad``: its fields are null. ``model`` names the request's model column.
    """
    asked = F.col(model) if model is not None else F.lit(None).cast("string")
    parsed = df.select(*keep, asked.alias("_model"), F.col(shape).alias("_shape"), F.col(raw).alias("_raw"),
                       F.try_parse_json(F.col(raw)).alias("_v"))
    v, shape_c = F.col("_v"), F.col("_shape")
    good = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))

    def there(path: str) -> Column:
        return F.try_variant_get(v, path, "variant").isNotNull()

    def text(path: str) -> Column:
        return F.when(there(path), F.try_variant_get(v, path, "string")).otherwise(F.lit(""))

    def count(path: str) -> Column:
        exact = F.try_variant_get(v, path, "decimal(38,9)")
        number = F.startswith(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("BIGINT"))
        return F.when(~there(path), F.lit(0).cast("bigint")).when(number, exact.cast("bigint"))

    local = shape_c.isin("local_complete", "local_chat")
    content = (F.when(shape_c == "local_complete", text("$.response"))
               .when(shape_c == "local_chat", text("$.message.content"))
               .otherwise(F.coalesce(text("$.choices[0].message.content"), F.lit(""))))
    nul = F.lit(None)
    return parsed.select(
        *keep,
        F.when(good, content).otherwise(nul).alias("content"),
        F.col("_model").alias("model"),
        F.when(good, F.when(local, count("$.prompt_eval_count")).otherwise(count("$.usage.prompt_tokens"))).alias("prompt_tokens"),
        F.when(good, F.when(local, count("$.eval_count")).otherwise(count("$.usage.completion_tokens"))).alias("completion_tokens"),
        F.when(good & ~local, count("$.usage.total_tokens")).alias("total_tokens"),
        F.col("_raw").alias("raw_response"),
        (~good).alias("bad"))


def model_available(reply: Column, model: Column) -> Column:
    """Requested model among ``models[].name`` of a logged model-list reply (missing name = '')."""
    models = F.from_json(reply, "models array<struct<name: string>>")["models"]
    names = F.transform(models, lambda m: F.coalesce(m["name"], F.lit("")))
    return F.coalesce(F.array_contains(names, model), F.lit(False))


# --- accounting (A5) ---

def usage_rollup(completions: DataFrame) -> DataFrame:
    return completions.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"))


# --- batch completion through provider functions (L16) ---

class ProviderError(Exception):
    """A provider failure with a kind (``completion``, ``connection``, ...)."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class HttpError(ProviderError):
    """The provider answered with an HTTP error."""

    def __init__(self, status: int, body: str):
        super().__init__("completion", COMPLETION_FAILED_TEMPLATE % (HTTP_ERROR_TEMPLATE % (status, body)))


class ConnectionFailed(ProviderError):
    """The provider can't be reached."""

    def __init__(self, url: str | None = None):
        super().__init__("connection", CONNECTION_FAILED + (CONNECTION_URL_TEMPLATE % url if url else ""))


def _mock_reply(options: dict, prompt_tokens: int, echo: dict) -> dict:
    content = options.get("mock_response")
    content = MOCK_RESPONSE if content is None else content
    return {"content": content, "model": MOCK_MODEL, "prompt_tokens": prompt_tokens,
            "completion_tokens": len(content.split()), "total_tokens": None, "raw": {"mock": True, **echo}}


def mock_provider(prompt: str, options: dict) -> dict:
    """Python twin of :func:`mock_complete` for the batch path; ``raw`` echoes the prompt."""
    return _mock_reply(options, len(prompt.split()), {"prompt": prompt})


def mock_chat_provider(messages: list[dict], options: dict) -> dict:
    """Python twin of :func:`mock_chat`: tokens summed over every message's content; ``raw`` echoes the messages."""
    return _mock_reply(options, sum(len((m.get("content") or "").split()) for m in messages), {"messages": messages})


PROVIDER_FUNCTIONS: dict[str, Callable[[str, dict], dict]] = {"mock": mock_provider}
CHAT_FUNCTIONS: dict[str, Callable[[list[dict], dict], dict]] = {"mock": mock_chat_provider}


def register_chat_function(name: str, fn: Callable[[list[dict], dict], dict]) -> None:
    CHAT_FUNCTIONS[name.lower()] = fn


def register_provider_function(name: str, fn: Callable[[str, dict], dict]) -> None:
    PROVIDER_FUNCTIONS[name.lower()] = fn


#: Options that reach a provider function, as resolved for the request (null ones are left out).
OPTIONS = ("model", "temperature", "max_tokens", "timeout", "host", "mock_response")
RESULT_SCHEMA = ("content string, model string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, "
                 "raw_response string, error_kind string, error_message string")
_RESULT = pa.schema([("content", pa.string()), ("model", pa.string()), ("prompt_tokens", pa.int64()),
                     ("completion_tokens", pa.int64()), ("total_tokens", pa.int64()), ("raw_response", pa.string()),
                     ("error_kind", pa.string()), ("error_message", pa.string())])


def _call(functions: dict, provider: str, given, options: dict) -> dict:
    """One request through its provider's function; whatever fails becomes an error row."""
    prefix = PROVIDER_PREFIX_TEMPLATE % provider
    try:
        if provider not in functions:
            raise ProviderError("configuration", BAD_CONFIG_TEMPLATE % provider + MISSING_FIELDS_TEMPLATE % "function")
        r = functions[provider](given, options)
        return {k: r.get(k) for k in ("content", "model", "prompt_tokens", "completion_tokens", "total_tokens")} | {
            "raw_response": None if r.get("raw") is None else json.dumps(r["raw"], ensure_ascii=False, default=str)}
    except ProviderError as exc:
        return {"error_kind": exc.kind, "error_message": prefix + str(exc)}
    except Exception as exc:  # noqa: BLE001 - a failed call is a row, never a failed task
        return {"error_kind": "completion", "error_message": prefix + COMPLETION_FAILED_TEMPLATE % exc}


#: Bytes of requests that are answered at a time: answers and their copies of the request are held as often.
REQUEST_BYTES = 1 << 20


def pieces(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, halved until a piece has ``REQUEST_BYTES`` at most or fewer than twice ``least`` rows."""
    if batch.nbytes <= REQUEST_BYTES or batch.num_rows < 2 * least:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), least)
    yield from pieces(batch.slice(half), least)


def _batches(functions: dict, concurrency: int, keep: list[str]):
    def call(row: dict) -> dict:
        if row["_error_kind"] is not None:
            return {"error_kind": row["_error_kind"], "error_message": row["_error_message"]}
        options = {k: row[f"_{k}"] for k in OPTIONS if row[f"_{k}"] is not None}
        return _call(functions, row["_provider"], row["_given"], options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = None
        if concurrency > 1:
            from concurrent.futures import ThreadPoolExecutor
            pool = ThreadPoolExecutor(max_workers=concurrency)  # one client pool per task, shared by its batches
        try:
            for batch in batches:
                # a pool's threads wait for each other at the end of a piece, so it has some requests for each of them
                for piece in pieces(batch, 1 if pool is None else 4 * concurrency):
                    rows = piece.drop_columns(keep).to_pylist()
                    out = list(pool.map(call, rows)) if pool else [call(r) for r in rows]  # map keeps input order
                    done = pa.RecordBatch.from_pylist(out, schema=_RESULT)
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *done.columns],
                                                     names=[*keep, *_RESULT.names])
        finally:
            if pool:
                pool.shutdown(wait=True)
    return run


def _through(requests: DataFrame, key: str, given: Column, provider: str | Column, override: Column | None,
             registry: ProviderRegistry | None, functions: dict, partitions: int | None, concurrency: int,
             carry: tuple[str, ...], failed: Column | None = None, ledger: AnswerLedger | None = None) -> DataFrame:
    from quire.session import ship_package

    ship_package(requests.sparkSession)
    registry = ProviderRegistry(list((registry or ProviderRegistry.default()).rows))
    for name in functions:  # a registered function makes a provider, with the default settings
        if name not in registry.names:
            registry.register(name)
    missing = {"model": "string", "temperature": "double", "max_tokens": "bigint", "timeout": "bigint"}
    asked = requests.withColumns({
        "_asked": F.lit(provider) if isinstance(provider, str) else provider, "_given": given,
        "_mock_response": override if override is not None else F.lit(None).cast("string"),
        **{c: F.lit(None).cast(t) for c, t in missing.items() if c not in requests.columns}})
    r = resolve_options(route_provider(asked, registry, "_asked"))
    bad_model = (F.col("registered_provider") == GATEWAY) & ~gateway_model_ok(F.col("eff_model"))
    kind = (F.when(F.col("_asked").isNull(), F.lit("not_configured"))
            .when(F.col("registered_provider").isNull(), F.lit("provider_not_found")).when(bad_model, F.lit("configuration")))
    message = F.coalesce(F.col("route_error"), F.when(bad_model, configuration_message(
        F.col("registered_provider"), [GATEWAY_MODEL_HINT])))
    if failed is not None:
        kind, message = F.when(failed.isNotNull(), F.lit("request")).otherwise(kind), F.coalesce(failed, message)
    keep = [key, *carry]
    slim = r.select(*keep, "_given", F.col("registered_provider").alias("_provider"), kind.alias("_error_kind"),
                    message.alias("_error_message"), F.col("eff_model").alias("_model"),
                    F.col("eff_temperature").alias("_temperature"), F.col("eff_max_tokens").alias("_max_tokens"),
                    F.col("eff_timeout").alias("_timeout"), F.rtrim(F.col("cfg_host"), F.lit("/")).alias("_host"), "_mock_response")
    if ledger is not None:
        return _by_ledger(slim, keep, ledger, functions, partitions, concurrency)
    if partitions:
        slim = slim.repartition(partitions, key)
    schema = slim.select(*keep).schema.simpleString()[len("struct<"):-1]
    return slim.mapInArrow(_batches(functions, concurrency, keep), f"{schema}, {RESULT_SCHEMA}")


def _by_ledger(slim: DataFrame, keep: list[str], ledger: AnswerLedger, functions: dict, partitions: int | None,
               concurrency: int) -> DataFrame:
    """Answers from the ledger; what it doesn't have is asked once a digest and written to it as it comes."""
    from quire.sources.ledger import digest_of

    asked = ["_provider", *(f"_{c}" for c in OPTIONS), "_given"]
    failed = [F.col("_error_kind"), F.col("_error_message")]
    slim = slim.select(*keep, *failed, *asked, digest_of(*asked).alias("_digest"))
    open_ = (slim.where("_error_kind is null").groupBy(F.col("_digest").alias("digest"))
             .agg(F.any_value(F.struct(*asked)).alias("q")).join(ledger.answers(RESULT_SCHEMA).select("digest"), "digest", "left_anti"))
    calls = open_.select("digest", "q.*", *(F.lit(None).cast("string").alias(c) for c in ("_error_kind", "_error_message")))
    if partitions:
        calls = calls.repartition(partitions, "digest")
    run = ledger.add(calls.mapInArrow(_batches(functions, concurrency, ["digest"]), f"digest string, {RESULT_SCHEMA}"))
    told = ledger.answers(RESULT_SCHEMA).unionByName(ledger.rows(RESULT_SCHEMA, run).where("error_kind is not null"))
    names = [f.name for f in _RESULT]
    known = slim.select(*keep, *failed, "_digest").join(told.withColumnRenamed("digest", "_digest"), "_digest", "left")
    return known.select(*keep, *(c for c in names if not c.startswith("error_")), F.coalesce("_error_kind", "error_kind").alias(
        "error_kind"), F.coalesce("_error_message", "error_message").alias("error_message"))


def complete_batch(requests: DataFrame, prompt: Column, provider: str | Column = "mock",
                   override: Column | None = None, partitions: int | None = None,
                   concurrency: int = 1, carry: tuple[str, ...] = (), key: str = "request_id",
                   registry: ProviderRegistry | None = None,
                   functions: dict[str, Callable[[str, dict], dict]] | None = None,
                   ledger: AnswerLedger | None = None) -> DataFrame:
    """Run every request through its provider's function: a result or an error per row.

    ``provider`` is a name or a column of names. Options (model, temperature,
    max_tokens, timeout: columns of ``requests``, where it has them) are
    resolved against the registry and handed to the function with the host and
    the override. Requests stay in the partitions they are in; ``partitions``
    deals them out by ``key`` (of any type) where slow calls are to be shared by
    more tasks, and ``concurrency`` > 1 overlaps network-bound calls within a
    task (results keep their order). ``carry`` columns pass through.

    With a ``ledger``, equal requests are asked once and answers are kept: the calls run when this function is called, a
    killed run's answers stay, and a rerun asks only for what has none. ``partitions`` then also says how often answers
    become safe: when the task that got them ends.
    """
    return _through(requests, key, prompt, provider, override, registry, functions or PROVIDER_FUNCTIONS, partitions,
                    concurrency, carry, ledger=ledger)


def chat_batch(chats: DataFrame, provider: str | Column = "mock", partitions: int | None = None, concurrency: int = 1,
               carry: tuple[str, ...] = (), key: str = "conv_id", override: Column | None = None,
               registry: ProviderRegistry | None = None,
               functions: dict[str, Callable[[list[dict], dict], dict]] | None = None,
               ledger: AnswerLedger | None = None) -> DataFrame:
    """L16 for chats: ``chats(conv_id, messages ARRAY<STRUCT<role, content>>, error)`` through chat functions.

    As :func:`complete_batch`; a chat with an ``error`` (its document isn't there) isn't sent, the error is its result.
    """
    failed = F.col("error") if "error" in chats.columns else None
    return _through(chats, key, F.col("messages"), provider, override, registry, functions or CHAT_FUNCTIONS, partitions,
                    concurrency, carry, failed, ledger)
