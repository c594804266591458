"""Chat formatting by schema fingerprints, in SQL functions alone (operator 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: The template.
START, END = "<|im_start|>", "<|im_end|>\n"


def _turn(role: str, path: str) -> str:
    return f"named_struct('role', '{role}', 'text', coalesce(try_variant_get(v, '{path}', 'string'), ''))"


def _list(path: str, role: str, text: str, names: dict[str, str]) -> str:
    read = f"try_variant_get(v, '{path}', 'array<struct<{role}:string,{text}:string>>')"
    name = f"coalesce(m.{role}, '')"
    for k, v in names.items():
        name = f"CASE WHEN m.{role} = '{k}' THEN '{v}' ELSE {name} END"
    return f"transform({read}, m -> named_struct('role', {name}, 'text', coalesce(m.{text}, '')))"


#: Fields that say nothing of a conversation's turns; a record may have them beside a layout's own.
BESIDE = ("id", "source", "lang", "license", "score", "created", "messages[].name", "messages[].id", "conversations[].id")

#: Layouts (roles of messages stay as they are; conversations[].from has names of its own for two of them): the field paths that a record must have and, but for those BESIDE, may
#: have (sorted leaves, [] for lists), and its canonical turns in SQL over the variant v.
LAYOUTS = {
    "completion,prompt": f"array({_turn('user', '$.prompt')}, {_turn('assistant', '$.completion')})",
    "prompt,response": f"array({_turn('user', '$.prompt')}, {_turn('assistant', '$.response')})",
    "answer,question": f"array({_turn('user', '$.question')}, {_turn('assistant', '$.answer')})",
    "completion,prompt,system": f"array({_turn('system', '$.system')}, {_turn('user', '$.prompt')}, {_turn('assistant', '$.completion')})",
    "instruction,output": f"array({_turn('user', '$.instruction')}, {_turn('assistant', '$.output')})",
    "input,instruction,output": (
        "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', try_variant_get(v, '$.instruction', 'string'), "
        f"nullif(try_variant_get(v, '$.input', 'string'), ''))), {_turn('assistant', '$.output')})"
    ),
    "messages[].content,messages[].role": _list("$.messages", "role", "content", {}),
    "conversations[].from,conversations[].value": _list("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
}


def fingerprint(paths: Column) -> Column:
    """Hash of a set of field paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), ","))


def field_paths(schema: Column) -> Column:
    """Leaf paths in the schema that Spark gives a variant; types are dropped. Lists of records count one level deep:
    OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>> has messages[].content and messages[].role."""
    lists = r"(\w+): ARRAY<OBJECT<([^<>]*)>>"
    names = lambda x: F.regexp_extract_all(x, F.lit(r"(\w+): "), F.lit(1))
    nested = F.transform(
        F.regexp_extract_all(schema, F.lit(lists), F.lit(0)),
        lambda x: F.transform(names(F.regexp_extract(x, lists, 2)), lambda leaf: F.concat(F.regexp_extract(x, lists, 1), F.lit("[]."), leaf)),
    )
    return F.concat(names(F.regexp_replace(schema, lists, "")), F.flatten(nested))


#: Spark's reader of JSON variants refuses large values (over 128 MiB), so the reason for no variant is asked for from here on.
LARGE = 16 << 20


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """(row, turns): each input row as a struct, and its turns as array<struct<role, text>>.

    `record` is a column of JSON. The fingerprint of its field paths, less those BESIDE, selects the layout in LAYOUTS. turns is null if the
    record is null, no JSON, or of a layout not listed; a null text is an empty one. A record of over 16 MiB that cannot be
    read fails with the reader's error, as it may be whole but too large."""
    variant = F.coalesce(F.try_parse_json(F.col(record)), F.when(F.octet_length(F.col(record)) > LARGE, F.parse_json(F.col(record))))
    parsed = records.select(F.struct(*[F.col(c) for c in records.columns]).alias("row"), variant.alias("v"))
    printed = parsed.select("row", "v", fingerprint(F.array_except(field_paths(F.schema_of_variant("v")), F.array(*[F.lit(p) for p in BESIDE]))).alias("print"))
    turns = F.lit(None).cast(TURNS)
    for paths, sql in LAYOUTS.items():
        turns = F.when(F.col("print") == fingerprint(F.split(F.lit(paths), ",")), F.expr(sql)).otherwise(turns)
    return printed.select("row", turns.alias("turns"))


def escaped(text: Column) -> Column:
    r"""No control string is left: \ becomes \\ and <| becomes <\|."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def formatted(turns: Column) -> Column:
    """One string: <|im_start|>role, a line break, the text, <|im_end|> and a line break for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), _role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END))), "")


def loss_mask(turns: Column) -> Column:
    """Where the loss counts: for each assistant turn its number, and the first code point (from 0) and the length of its escaped text
    within the turn, counted after <|im_start|>."""
    spans = F.transform(turns, lambda t, i: F.struct(i.alias("turn"), (F.length(_role(t["role"])) + 1).alias("first"), F.length(escaped(t["text"])).alias("length"), (t["role"] == "assistant").alias("own")))
    return F.transform(F.filter(spans, lambda s: s["own"]), lambda s: F.struct(s["turn"], s["first"], s["length"]))


def _pieces(text: Column) -> Column:
    parts = F.split(text, r"<\|im_start\|>", -1)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def read_back(text: Column) -> Column:
    """The turns of a formatted string."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.struct(_role_back(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(_pieces(text), turn)


def loss_text(text: Column, mask: Column) -> Column:
    """What the mask covers in a formatted string, unescaped."""
    pieces = _pieces(text)
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(F.get(pieces, m["turn"]), m["first"] + 1, m["length"]))), "")


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """(row, turns, formatted, mask) of each record; see canonical(). Where turns is null, so are formatted and mask."""
    return canonical(records, record).select("row", "turns", formatted(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("mask"))


#: Conversations of more bytes of text are formatted turn by turn and never put together in one row.
TOGETHER = 4 << 20


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows (conv_id, turn, role, text) of each conversation as one JSON record, in order of turn, then role
    and text. A null role or text is an empty one; rows without conv_id are one conversation; repeated rows stay.

    A hash of conv_id deals conversations to the layouts that can hold them: a user's and an assistant's turn, also behind one of the system, to those of
    prompts, questions and instructions; any others to messages, or to conversations where no role is named as that layout names its own.

    A conversation's turns meet in one row here; format_turns() keeps large ones apart."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles, text = F.array_join(F.transform("t", lambda x: x["role"]), "\n"), lambda k: F.get("t", F.lit(k))["text"]
    listed = lambda name, role, content, named: F.to_json(F.struct(F.transform("t", lambda x: F.struct(named(x["role"]).alias(role), x["text"].alias(content))).alias(name)))
    from_name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    pair = [(("prompt", 0), ("completion", 1)), (("prompt", 0), ("response", 1)), (("question", 0), ("answer", 1)), (("instruction", 0), ("output", 1)), (("instruction", 0), ("input", None), ("output", 1))]
    flat = lambda fields: F.to_json(F.struct(*[(F.lit("") if k is None else text(k)).alias(n) for n, k in fields]))
    deal = lambda n: F.pmod(F.xxhash64("conv_id"), F.lit(n))
    of_pair = F.element_at(F.array(*[flat(f) for f in pair]), (deal(len(pair)) + 1).cast("int"))
    clear = ~F.exists("t", lambda x: x["role"].isin("human", "gpt"))
    record = (
        F.when(roles == "user\nassistant", of_pair).when(roles == "system\nuser\nassistant", flat((("system", 0), ("prompt", 1), ("completion", 2))))
        .when(clear & (deal(2) == 0), listed("conversations", "from", "value", from_name)).otherwise(listed("messages", "role", "content", lambda r: r))
    )
    return turns.select("conv_id", record.alias("record"))


def format_turns(rows: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(conv_id, turn, formatted, mask) of each row (conv_id, turn, role, text). A conversation's string is its turns' strings joined in order of turn, role and
    text; turn is a turn's place among them (of conversations of over `together` bytes, its own number).

    Conversations are records in the layouts of as_records(); the fingerprint of each record finds its turns, which are formatted one by one. One of over
    `together` bytes goes turn by turn, each a record of one message, so its size sets no limit."""
    sizes = rows.groupBy("conv_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0)) + 32).alias("_n"))
    large = sizes.where(F.col("_n") > together).select(F.col("conv_id").alias("_c"))
    own = rows.select("conv_id", "turn", "role", "text")
    is_large = F.col("conv_id").eqNullSafe(F.col("_c"))
    whole = canonical(as_records(own.join(large, is_large, "left_anti"))).select("row.conv_id", F.posexplode("turns").alias("turn", "_t"))
    message = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    parts = own.join(large, is_large, "left_semi").select("conv_id", "turn", F.to_json(F.struct(F.array(message).alias("messages"))).alias("record"))
    single = canonical(parts).select("row.conv_id", "row.turn", F.col("turns")[0].alias("_t"))
    one = F.array("_t")
    return whole.unionByName(single).select("conv_id", "turn", formatted(one).alias("formatted"), loss_mask(one).alias("mask"))
