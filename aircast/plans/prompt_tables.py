"""Queries: prompt tables (I1-I11), H8, C5, E6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as X
from ..sources import fixtures as fx
from . import history as H
from . import prompts as P
from .daily_tables import half_even_sql, weather_of
from .registry import cte, query, r6, with_
from .trend_tables import _LINE_SQL, hourly_latest, runs_table

AS_OF = "2024-01-30"
D = f"DATE '{AS_OF}'"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {lit(w)})" for w in words) + ")"


def month_sql(m: str) -> str:
    return "(CASE lower(" + m + ") " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.MONTHS.items()) + " END)"


def valid_sql(y: str, m: str, d: str) -> str:
    mm = f"least(greatest({m}, 1), 12)"
    last = f"day(last_day(make_date({y}, {mm}, 1)))"
    return (
        f"(CASE WHEN ({m}) BETWEEN 1 AND 12 AND ({d}) BETWEEN 1 AND {last} "
        f"THEN make_date({y}, {mm}, least(greatest({d}, 1), {last})) END)"
    )


def fdate_sql(p: str) -> str:
    lp = f"lower({p})"
    md, dm, tm, td, ys = X.FORECAST_DATE_PATTERNS
    all_ = lambda pat, g: f"regexp_extract_all({lp}, {lit(pat)}, {g})"
    y = f"CAST(year({D}) AS INT)"

    def first(pat: str, month: int, day: int) -> str:
        dates = f"list_transform(list_zip({all_(pat, month)}, {all_(pat, day)}), lambda t: {valid_sql(y, month_sql('t[1]'), 'TRY_CAST(t[2] AS INT)')})"
        return f"list_extract(list_filter({dates}, lambda d: d IS NOT NULL), 1)"

    return (
        f"coalesce({first(md, 1, 2)}, {first(dm, 2, 1)}, "
        f"CASE WHEN regexp_matches({lp}, {lit(tm)}) THEN CAST({D} + 1 AS DATE) END, "
        f"CASE WHEN regexp_matches({lp}, {lit(td)}) THEN {D} END, "
        f"CASE WHEN regexp_matches({lp}, {lit(ys)}) THEN CAST({D} - 1 AS DATE) END)"
    )


def route_sql(p: str) -> str:
    fc = any_sql(p, X.FORECAST_WORDS)
    return f"""(CASE WHEN starts_with({p}, 'play ') THEN 'play'
  WHEN contains({p}, 'pause') THEN 'pause'
  WHEN contains({p}, 'resume') OR contains({p}, 'continue') THEN 'resume'
  WHEN contains({p}, 'skip') OR contains({p}, 'next') THEN 'skip'
  WHEN contains({p}, 'stop music') OR contains({p}, 'stop song') THEN 'stop_music'
  WHEN contains({p}, 'light') AND contains({p}, 'on') THEN 'light_on'
  WHEN contains({p}, 'light') AND contains({p}, 'off') THEN 'light_off'
  WHEN contains({p}, 'measure') AND contains({p}, 'now') THEN 'measure'
  WHEN contains({p}, 'forecast') AND contains({p}, 'run') THEN 'run_forecast'
  WHEN {any_sql(p, X.WEATHER_WORDS)} THEN 'weather'
  WHEN {fc} AND {fdate_sql(p)} IS NOT NULL THEN 'forecast_day'
  WHEN {fc} THEN 'forecast'
  WHEN {any_sql(p, X.CLIMATE_WORDS)} THEN 'climate'
  ELSE 'general' END)"""


def offset_sql(p: str) -> str:
    return "(CASE " + " ".join(f"WHEN contains(lower({p}), {lit(ph)}) THEN {o}" for ph, o in X.RELATIVE_DATES) + " END)"


def absdate_sql(p: str) -> tuple[str, str]:
    cp = f"regexp_replace(lower({p}), '[?!.,;]', '', 'g')"
    p1, p2, p3 = X.WEATHER_DATE_PATTERNS
    ex = lambda pat, g: f"regexp_extract({cp}, {lit(pat)}, {g})"
    yr = lambda pat: f"coalesce(TRY_CAST(nullif({ex(pat, 3)}, '') AS INT), CAST(year({D}) AS INT))"
    d = (
        f"(CASE WHEN regexp_matches({cp}, {lit(p1)}) THEN {valid_sql(yr(p1), month_sql(ex(p1, 1)), f'TRY_CAST({ex(p1, 2)} AS INT)')} "
        f"WHEN regexp_matches({cp}, {lit(p2)}) THEN {valid_sql(yr(p2), month_sql(ex(p2, 2)), f'TRY_CAST({ex(p2, 1)} AS INT)')} "
        f"WHEN regexp_matches({cp}, {lit(p3)}) THEN {valid_sql(yr(p3), f'TRY_CAST({ex(p3, 1)} AS INT)', f'TRY_CAST({ex(p3, 2)} AS INT)')} END)"
    )
    matched = f"(regexp_matches({cp}, {lit(p1)}) OR regexp_matches({cp}, {lit(p2)}) OR regexp_matches({cp}, {lit(p3)}))"
    return d, matched


def pytext_sql(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


cte("pr", f"SELECT prompt_id, room_id, prompt, {route_sql('prompt')} AS intent FROM prompts", "prompts")
_ABS, _MATCHED = absdate_sql("prompt")
cte(
    "wt",
    f"""SELECT *, CASE WHEN off IS NULL AND matched AND ad IS NULL THEN 'invalid'
                   WHEN target_date > CAST({D} + 15 AS DATE) THEN 'too_far' ELSE 'ok' END AS status
FROM (SELECT *, CASE WHEN off IS NOT NULL THEN CAST({D} + off AS DATE) WHEN matched THEN ad ELSE {D} END AS target_date
      FROM (SELECT prompt_id, room_id, prompt, {offset_sql('prompt')} AS off, {_ABS} AS ad, {_MATCHED} AS matched FROM prompts))""",
    "prompts",
)


def prompts_of(spark, sf):
    return P.with_intent(fx.prompts(spark, sf), AS_OF)


@query(
    "topic_flags",
    with_(
        f"SELECT prompt_id, {any_sql('prompt', X.CLIMATE_WORDS)} AS is_climate, {any_sql('prompt', X.FORECAST_WORDS)} AS is_forecast, "
        f"{any_sql('prompt', X.WEATHER_WORDS)} AS is_weather FROM prompts",
        "prompts",
    ),
)
def topic_flags(spark, sf):
    """Climate / forecast / weather flags of every prompt."""
    p = F.col("prompt")
    return fx.prompts(spark, sf).select(
        "prompt_id", X.is_climate(p).alias("is_climate"), X.is_forecast(p).alias("is_forecast"), X.is_weather(p).alias("is_weather")
    )


@query("route_prompt", with_("SELECT prompt_id, intent FROM pr", "pr"))
def route_prompt(spark, sf):
    """Intent of every prompt (ordered tests, first hit wins)."""
    return prompts_of(spark, sf).select("prompt_id", "intent")


@query(
    "relative_date",
    with_(f"SELECT prompt_id, CAST(off AS BIGINT) AS day_offset, CAST({D} + off AS DATE) AS rel_date FROM wt", "wt"),
)
def relative_date(spark, sf):
    """I3 (NULL when no relative phrase)."""
    off = X.relative_offset(F.col("prompt"))
    return fx.prompts(spark, sf).select(
        "prompt_id", off.alias("day_offset"), F.date_add(F.lit(AS_OF).cast("date"), off).alias("rel_date")
    )


@query("absolute_date", with_("SELECT prompt_id, ad AS abs_date, matched FROM wt", "wt"))
def absolute_date(spark, sf):
    """I4 (matched with a NULL date = invalid)."""
    d, m = X.absolute_date(F.col("prompt"), F.lit(AS_OF).cast("date"))
    return fx.prompts(spark, sf).select("prompt_id", d.alias("abs_date"), m.alias("matched"))


@query("date_horizon", with_("SELECT prompt_id, target_date, status FROM wt", "wt"))
def date_horizon(spark, sf):
    """Target day of a weather question and ok / invalid / too_far."""
    t, s = X.weather_target(F.col("prompt"), F.lit(AS_OF).cast("date"))
    return fx.prompts(spark, sf).select("prompt_id", t.alias("target_date"), s.alias("status"))


@query("forecast_date", with_(f"SELECT prompt_id, {fdate_sql('prompt')} AS target_date FROM prompts", "prompts"))
def forecast_date(spark, sf):
    """I6 (NULL when the prompt names no day)."""
    return fx.prompts(spark, sf).select(
        "prompt_id", X.forecast_date(F.col("prompt"), F.lit(AS_OF).cast("date")).alias("target_date")
    )


_DAYNAME = (
    "CASE WHEN contains(lower(prompt), 'today') THEN 'today' WHEN contains(lower(prompt), 'tomorrow') THEN 'tomorrow' "
    "ELSE strftime(target_date, '%A') END"
)


@query(
    "day_name",
    with_(f"SELECT prompt_id, {_DAYNAME} AS day_name FROM (SELECT prompt_id, prompt, coalesce({fdate_sql('prompt')}, {D}) AS target_date FROM prompts)", "prompts"),
)
def day_name(spark, sf):
    """H8: 'today' / 'tomorrow' / weekday name of each prompt's target day."""
    d = F.lit(AS_OF).cast("date")
    p = fx.prompts(spark, sf)
    t = F.coalesce(X.forecast_date(F.col("prompt"), d), d)
    return p.select("prompt_id", cal.day_name(F.col("prompt"), t).alias("day_name"))


cte(
    "lookup",
    f"""SELECT q.prompt_id, q.room_id, q.prompt, q.target_date, f.pred_co2, f.pred_temp, f.advies
FROM (SELECT prompt_id, room_id, prompt, coalesce({fdate_sql('prompt')}, {D}) AS target_date FROM pr WHERE intent = 'forecast_day') q
LEFT JOIN latest_run f ON f.room_id = q.room_id AND f.ds = q.target_date""",
    "pr",
    "latest_run",
)


def lookup_of(spark, sf):
    p = prompts_of(spark, sf).where(F.col("intent") == "forecast_day")
    return P.forecast_lookup(p, H.latest_run(runs_table(spark, sf)), as_of=AS_OF)


@query(
    "forecast_lookup",
    with_("SELECT prompt_id, room_id, target_date, round(pred_co2, 6) AS pred_co2, round(pred_temp, 6) AS pred_temp, advies FROM lookup", "lookup")
    .replace("round(pred_co2, 6) AS pred_co2", r6("pred_co2", "pred_co2"))
    .replace("round(pred_temp, 6) AS pred_temp", r6("pred_temp", "pred_temp")),
)
def forecast_lookup(spark, sf):
    """A forecast-day prompt matched to its room's latest forecast."""
    return lookup_of(spark, sf).select("prompt_id", "room_id", "target_date", "pred_co2", "pred_temp", "advies")


_DAY_ANSWER = (
    "CASE WHEN pred_co2 IS NULL AND pred_temp IS NULL THEN "
    + lit(P.NO_FORECAST.replace("%s", "\x00")).replace("\x00", "' || strftime(target_date, '%Y-%m-%d') || '")
    + f" ELSE 'Forecast for ' || {_DAYNAME} || ' (' || strftime(target_date, '%Y-%m-%d') || '):' || chr(10) || "
    f"'Predicted CO₂: ' || CAST(CAST({half_even_sql('pred_co2')} AS BIGINT) AS VARCHAR) || ' ppm' || chr(10) || "
    f"'Predicted Temperature: ' || CAST({half_even_sql('pred_temp', 1)} AS VARCHAR) || '°C' || chr(10) || "
    "'Advice: ' || coalesce(advies, 'No specific advice available') END"
)


@query("day_answer", with_(f"SELECT prompt_id, room_id, {_DAY_ANSWER} AS answer FROM lookup", "lookup"))
def day_answer(spark, sf):
    """One-day forecast answers (or the no-data text) for forecast-day prompts."""
    return P.day_answer(lookup_of(spark, sf)).select("prompt_id", "room_id", "answer")


_WEATHER_TEXT = (
    "'📅 Weather forecast for ' || strftime(target_date, '%B %d, %Y') || ' in Brussels:' || chr(10) || "
    f"'- 🌡️ Max temp: ' || {pytext_sql('w.outside_temp_max')} || '°C' || chr(10) || "
    f"'- 🌡️ Min temp: ' || {pytext_sql('w.outside_temp_min')} || '°C' || chr(10) || "
    f"'- ☁️ Cloud cover: ' || {pytext_sql('w.cloudcover')} || '%' || chr(10) || "
    f"'- 💨 Wind: ' || {pytext_sql('w.wind')} || ' km/h' || chr(10) || "
    f"'- 🌧️ Precipitation: ' || {pytext_sql('w.precipitation')} || ' mm' || chr(10)"
)


@query(
    "weather_answer",
    with_(
        f"""SELECT t.prompt_id, t.target_date, t.status,
       CASE WHEN t.status = 'invalid' THEN {lit(P.DATE_INVALID)} WHEN t.status = 'too_far' THEN {lit(P.TOO_FAR)}
            WHEN w.outside_temp_max IS NULL THEN {lit(P.NO_WEATHER)} ELSE {_WEATHER_TEXT} END AS answer
FROM wt t JOIN pr ON pr.prompt_id = t.prompt_id AND pr.intent = 'weather'
LEFT JOIN weather w ON w.ds = t.target_date""",
        "wt",
        "pr",
        "weather",
    ),
)
def weather_answer(spark, sf):
    """I8: weather prompts answered from the weather table."""
    p = prompts_of(spark, sf).where(F.col("intent") == "weather")
    return P.weather_answer(p, weather_of(spark, sf), as_of=AS_OF).select("prompt_id", "target_date", "status", "answer")


_GENERAL_SQL = "'The user asked: ' || prompt || chr(10) || 'Respond as Luna, a helpful and emotional human assistant.'"


@query(
    "climate_context",
    with_(
        f"""SELECT q.prompt_id, q.room_id,
       CASE WHEN e.max_co2 IS NULL THEN {_GENERAL_SQL.replace('prompt', 'q.prompt')}
       ELSE {lit(P.CLIMATE_HEAD)} || c.tbl || chr(10) || chr(10) || 'Important data:' || chr(10) ||
            'Highest CO₂ level: ' || CAST(e.max_co2 AS VARCHAR) || ' ppm at ' || substr(e.max_ts, 12, 5) || chr(10) ||
            'Lowest CO₂ level: ' || CAST(e.min_co2 AS VARCHAR) || ' ppm at ' || substr(e.min_ts, 12, 5) || chr(10) || chr(10) ||
            'User question: ' || q.prompt || chr(10) || {lit(P.CLIMATE_TAIL)} END AS context
FROM (SELECT * FROM pr WHERE intent = 'climate') q
LEFT JOIN (SELECT room_id, string_agg({_LINE_SQL}, chr(10) ORDER BY ts) AS tbl FROM hourly_latest
           WHERE day = {D} GROUP BY room_id) c ON c.room_id = q.room_id
LEFT JOIN (SELECT room_id, max(co2) AS max_co2, first(ts_raw ORDER BY co2 DESC, ts DESC) AS max_ts,
                  min(co2) AS min_co2, first(ts_raw ORDER BY co2 ASC, ts DESC) AS min_ts
           FROM hourly_latest WHERE day = {D} AND co2 IS NOT NULL GROUP BY room_id) e ON e.room_id = q.room_id""",
        "pr",
        "hourly_latest",
    ),
)
def climate_context(spark, sf):
    """Climate prompts -> today's hourly rows of the room plus highest and lowest CO2, as one prompt text."""
    p = prompts_of(spark, sf).where(F.col("intent") == "climate")
    return P.climate_context(p, hourly_latest(spark, sf), as_of=AS_OF).select("prompt_id", "room_id", "context")


_FLINE = (
    f"strftime(ds, '%Y-%m-%d') || ' → Predicted CO2: ' || CAST(CAST({half_even_sql('pred_co2')} AS BIGINT) AS VARCHAR) || "
    f"' ppm, Predicted Temp: ' || CAST({half_even_sql('pred_temp', 1)} AS VARCHAR) || '°C, Outside max: ' || "
    f"{pytext_sql('outside_temp_max')} || '°C, Solar: ' || {pytext_sql('solar_radiation')} || ', Rain: ' || "
    f"{pytext_sql('precipitation')} || ' mm, Wind: ' || {pytext_sql('wind')} || ' km/h, Clouds: ' || "
    f"{pytext_sql('cloudcover')} || '%, Advice: ' || coalesce(advies, '—')"
)


@query(
    "forecast_context",
    with_(
        f"""SELECT q.prompt_id, q.room_id,
       CASE WHEN t.tbl IS NULL THEN {_GENERAL_SQL.replace('prompt', 'q.prompt')}
       ELSE {lit(P.FORECAST_HEAD + 'Forecast data:' + chr(10))} || t.tbl || chr(10) || chr(10) || 'User question: ' || q.prompt ||
            chr(10) || {lit(P.FORECAST_TAIL)} END AS context
FROM (SELECT * FROM pr WHERE intent = 'forecast') q
LEFT JOIN (SELECT room_id, string_agg({_FLINE}, chr(10) ORDER BY ds) AS tbl FROM latest_run GROUP BY room_id) t
  ON t.room_id = q.room_id""",
        "pr",
        "latest_run",
    ),
)
def forecast_context(spark, sf):
    """Forecast prompts -> the room's latest 7-day forecast as one prompt text."""
    p = prompts_of(spark, sf).where(F.col("intent") == "forecast")
    return P.forecast_context(p, H.latest_run(runs_table(spark, sf))).select("prompt_id", "room_id", "context")


_CMD = "CASE " + " ".join(
    "WHEN lower(trim(prompt)) IN (" + ", ".join(lit(w) for w in ws) + f") THEN '{k}'" for k, ws in X.MUSIC_COMMANDS.items()
) + " END"


_CMD_T = _CMD.replace("prompt", "text")


@query(
    "wake_and_commands",
    with_(
        f"""SELECT 'prompt' AS source, prompt_id AS text_id, contains(lower(prompt), '{X.WAKE_PHRASE}') AS wake, {_CMD} AS command
FROM prompts
UNION ALL
SELECT 'turn', conv_id * 1000 + turn, contains(lower(text), '{X.WAKE_PHRASE}'), {_CMD_T} FROM turns""",
        "prompts",
        "turns",
    ),
)
def wake_and_commands(spark, sf):
    """Wake phrase and exact music commands over every prompt and every
    conversation turn (whole texts)."""
    p = fx.prompts(spark, sf).select(F.lit("prompt").alias("source"), F.col("prompt_id").alias("text_id"), F.col("prompt").alias("text"))
    t = fx.turns(spark, sf).select(F.lit("turn").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    u = p.unionByName(t)
    return u.select("source", "text_id", X.wake_label(F.col("text")).alias("wake"), X.command_label(F.col("text")).alias("command"))


_WORDS = "CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"


@query(
    "trim_history",
    with_(
        f"""SELECT conv_id, turn, role, CAST(n_words AS BIGINT) AS n_words, CAST(running AS BIGINT) AS running,
       running + 1000 <= 16385 AS kept
FROM (SELECT conv_id, turn, role, n_words,
             sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
      FROM (SELECT conv_id, turn, role, {_WORDS} AS n_words FROM turns))""",
        "turns",
    ),
)
def trim_history(spark, sf):
    """E6 over every conversation."""
    return P.trim_history(fx.turns(spark, sf)).select("conv_id", "turn", "role", "n_words", "running", "kept")
