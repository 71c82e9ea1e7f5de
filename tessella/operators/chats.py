"""Chat sessions from turns, and the events of a running task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import col, trim

# Fixed values
KEPT_CHATS, TITLE_UNITS, NEW_CHAT = 80, 34, "新しいチャット"
DELTA_CHARS = 80
DONE, STOPPED, WORKING = "仕上げています", "停止しました", "処理しています"
STAGES = {"profile": "質問の意図を整理しています", "retrieve": "関連しそうな資料を探しています", "synthesize": "根拠を統合しています", "audit": "回答のズレを点検しています", "answer": "回答を整えています", "index": "資料を読み込んでいます"}
EXTRACT = {"again": "見落としがないか再確認しています", "start": "資料を読み始めています", "middle": "根拠を拾い集めています", "end": "条件や例外を照合しています", "open": "根拠を抽出しています"}
API = {"limit": "API制限の回復を待っています", "stop": "API応答で停止しました"}
API_STAGES = {"profile": "質問の意図を整理しています", "retrieve": "資料検索を準備しています", "extract": "根拠抽出を進めています", "synthesize": "回答を組み立てています", "audit": "回答のズレを点検しています", "answer": "回答を整えています"}


def title(text: Column | str) -> Column:
    """Collapsed white space, at most 34 UTF-16 units."""
    x = F.regexp_replace(trim(text), r"(?U)\s+", " ")
    units = F.octet_length(F.encode(x, "UTF-16BE")) / 2
    # characters beyond the basic plane are two units: take characters while their units fit
    size = lambda c: F.when(F.octet_length(c) >= 4, 2).otherwise(1)
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    grow = F.aggregate(F.split(F.substring(x, 1, TITLE_UNITS), ""), start, lambda a, c: F.struct(F.when(a.getField("n") + size(c) <= TITLE_UNITS, F.concat(a.getField("s"), c)).otherwise(a.getField("s")).alias("s"), (a.getField("n") + F.when(c == "", 0).otherwise(size(c))).alias("n")))
    return F.when(F.coalesce(x, F.lit("")) == "", NEW_CHAT).when(units > TITLE_UNITS, F.concat(grow.getField("s"), F.lit("..."))).otherwise(x)


def sessions(turns: DataFrame) -> DataFrame:
    """(conv_id, title, n_messages, n_user, last_turn) from (conv_id, turn, role, text): blank messages go, any role but assistant is user."""
    rows = turns.where(F.length(trim("text")) > 0).withColumn("role", F.when(F.col("role") == "assistant", "assistant").otherwise("user"))
    user = F.col("role") == "user"
    out = rows.groupBy("conv_id").agg(F.min_by("text", F.when(user, F.col("turn"))).alias("first"), F.count("*").alias("n_messages"), F.count_if(user).alias("n_user"), F.max("turn").alias("last_turn"))
    return out.select("conv_id", title(F.coalesce("first", F.lit(""))).alias("title"), "n_messages", "n_user", "last_turn")


def kept_sessions(chats: DataFrame, order: str) -> DataFrame:
    """The first of each id in list order, and of these the first 80."""
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy(order))
    return chats.withColumn("_nth", nth).where("_nth = 1").drop("_nth").orderBy(order).limit(KEPT_CHATS)


def archived(chats: DataFrame, conv_id: int, on: bool) -> DataFrame:
    return chats.withColumn("archived", F.when(F.col("conv_id") == conv_id, F.lit(on)).otherwise(F.col("archived")))


def restored(chats: DataFrame, conv_id: int) -> DataFrame:
    """An archived chat back in the list."""
    return archived(chats, conv_id, False)


def deleted(chats: DataFrame, conv_id: int) -> DataFrame:
    """The chats without an archived one; a chat that isn't archived stays."""
    return chats.where((F.col("conv_id") != conv_id) | ~F.col("archived"))


def deltas(text: Column | str) -> Column:
    """An answer in pieces that end after 80 characters or at a line end."""
    n = DELTA_CHARS
    return F.regexp_extract_all(col(text), F.lit(f"[^\\n]{{0,{n - 1}}}\\n|[^\\n]{{{n}}}|[^\\n]+"), F.lit(0))


def sse_text(captured: Column | str) -> Column:
    """The text that a captured stream of data: lines carries, up to [DONE]."""
    lines = F.transform(F.filter(F.split(col(captured), "\r?\n"), lambda x: x.startswith("data:")), lambda x: trim(F.substring(x, 6, 1 << 30)))
    end = F.array_position(lines, "[DONE]")
    live = F.when(end > 0, F.slice(lines, F.lit(1), (end - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.transform(live, lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit(""))), "")


def _lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if default is None else default
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def progress_title(stage: Column, status: Column, message: Column, done: Column, total: Column, last_stage: Column) -> Column:
    """What the interface says for a progress event."""
    share = F.coalesce(F.try_divide(done, total), F.lit(0.0))
    extract = F.when(F.contains(message, F.lit("追加検索")) | F.contains(message, F.lit("再確認")), EXTRACT["again"]).when(total <= 0, EXTRACT["open"]).when(share < 0.25, EXTRACT["start"]).when(share < 0.7, EXTRACT["middle"]).otherwise(EXTRACT["end"])
    api = F.when(F.contains(message, F.lit("制限")), API["limit"]).when(F.contains(message, F.lit("停止")), API["stop"]).otherwise(_lookup(API_STAGES, last_stage, F.lit(WORKING)))
    return F.when(status.isin("cancelled", "stopped"), STOPPED).when(status == "complete", DONE).when(stage == "extract", extract).when(stage == "api", api).otherwise(_lookup(STAGES, stage, F.lit(WORKING)))
