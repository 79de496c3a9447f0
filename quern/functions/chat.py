"""Instruction and chat examples: normal columns, templates, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import col
from .text import strip

NORMAL = ("_norm_instruction", "_norm_input", "_norm_output")
MESSAGES = "array<struct<role:string,content:string,from:string,value:string>>"
FORMATS = ("llama3", "llama2", "mistral", "gemma", "alpaca", "sharegpt", "openai")


def detect(columns: list[str]) -> tuple[str, str]:
    """Input format by column names, case ignored, and a note."""
    have = {c.lower() for c in columns}
    rules = (("sharegpt", have & {"messages", "conversations"}), ("alpaca", have >= {"instruction", "output"}), ("qa_pairs", have >= {"question", "answer"} or have >= {"q", "a"}), ("raw_pairs", have >= {"prompt", "completion"}))
    for name, ok in rules:
        if ok:
            return name, f"Detected input format {name} from the column names."
    return "raw_pairs", "No known input format; the first two columns are taken for prompt and completion."


def _first_said(messages: Column, role: str, sender: str) -> Column:
    said = F.filter(messages, lambda m: F.coalesce((m["role"] == role) | (m["from"] == sender), m["role"] == role, m["from"] == sender, F.lit(False)))
    first = F.get(said, F.lit(0))
    return F.coalesce(first["content"], first["value"], F.lit(""))


def normalise(df: DataFrame, input_format: str = "auto", instruction: str | None = None, input_column: str | None = None, output: str | None = None) -> tuple[DataFrame, str, str]:
    """Adds the three normal columns; nulls are empty. Also the format and a note."""
    note = ""
    if input_format == "auto":
        input_format, note = detect(df.columns)
    by_name = {c.lower(): c for c in df.columns}
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    named = lambda *names, default=None: text(next((by_name[n] for n in names if n in by_name), default))
    first, second = df.columns[0], df.columns[min(1, len(df.columns) - 1)]
    if input_format == "sharegpt":
        column = next((c for c in ("messages", "conversations") if c in df.columns), first)
        raw = col(column)
        messages = F.from_json(raw, MESSAGES) if dict(df.dtypes)[column] == "string" else F.from_json(F.to_json(raw), MESSAGES)
        messages = F.when(F.size(messages) >= 2, messages)
        normal = _first_said(messages, "user", "human"), F.lit(""), _first_said(messages, "assistant", "gpt")
    elif input_format == "alpaca":
        normal = named("instruction"), named("input"), named("output")
    elif input_format == "qa_pairs":
        normal = named("question", "q", default=first), F.lit(""), named("answer", "a", default=df.columns[-1])
    elif input_format == "raw_pairs":
        normal = named("prompt", default=first), F.lit(""), named("completion", default=second)
    else:
        normal = text(instruction or ""), text(input_column or ""), text(output or "")
    return df.withColumns(dict(zip(NORMAL, normal, strict=True))), input_format, note


def formatted(target: str, instruction: Column, extra: Column, output: Column, system: str = "") -> Column:
    """One training example: text of a chat template, or JSON text of a structure."""
    whole = F.when(extra != "", strip(F.concat(instruction, F.lit("\n"), extra))).otherwise(instruction)
    s = F.lit(system)
    if target == "llama3":
        head = "<|begin_of_text|>" + (f"<|start_header_id|>system<|end_header_id|>\n{system}<|eot_id|>" if system else "")
        return F.concat(F.lit(head + "<|start_header_id|>user<|end_header_id|>\n"), whole, F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"), output, F.lit("<|eot_id|>"))
    if target == "llama2":
        return F.concat(F.lit("<s>[INST] " + (f"<<SYS>>{system}<</SYS>> " if system else "")), whole, F.lit(" [/INST] "), output, F.lit(" </s>"))
    if target == "mistral":
        return F.concat(F.lit("<s>[INST] "), strip(F.concat(s, F.lit("\n\n"), whole)) if system else whole, F.lit(" [/INST] "), output, F.lit("</s>"))
    if target == "gemma":
        return F.concat(F.lit("<start_of_turn>user\n" + (f"{system}\n\n" if system else "")), whole, F.lit("<end_of_turn>\n<start_of_turn>model\n"), output, F.lit("<end_of_turn>"))
    if target == "alpaca":
        return F.to_json(F.struct(instruction.alias("instruction"), extra.alias("input"), output.alias("output")))
    if target == "sharegpt":
        turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
        return F.to_json(F.struct(F.array(turn("human", whole), turn("gpt", output)).alias("conversations")))
    turn = lambda who, c: F.struct(F.lit(who).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.array(*([turn("system", s)] if system else []), turn("user", whole), turn("assistant", output)).alias("messages")))


def token_estimate(text: Column) -> Column:
    """Without a vocabulary: a token for each word piece of up to five letters, digit triple or other mark."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}{1,5}|\p{N}{1,3}|[^\s\p{L}\p{N}]")), F.lit(0)).cast("long")
