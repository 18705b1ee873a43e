"""Conversation assembly (D1-D11) and chat-format rendering.

Two message shapes:

* text form  ``struct<role string, content string>`` -- text-only models and
  every chat-format renderer;
* part form  ``struct<role string, content array<struct<type, text, image>>>``
  -- vision models: image parts first, then one text part.

All functions are higher-order array expressions evaluated inside the JVM;
nothing is collected and no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.constants import CHATML, FOLD_SEPARATOR, HEADER, IMAGE_TOKEN, INST, INSTRUCTION_RESPONSE, TURN
from evalframe.functions.parsing import strip_text

PART_TYPE = "struct<type:string,text:string,image:string>"
PART_MSG_TYPE = f"struct<role:string,content:array<{PART_TYPE}>>"
TEXT_MSG_TYPE = "struct<role:string,content:string>"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _truthy(text: Column) -> Column:
    return text.isNotNull() & (text != F.lit(""))


# ---------------------------------------------------------------------------
# message construction
# ---------------------------------------------------------------------------

def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("image"))


def image_part(path: Column) -> Column:
    return F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), path.cast("string").alias("image"))


def message(role: Column | str, content: Column, typed: bool, images: Column | None = None) -> Column:
    role_c = F.lit(role) if isinstance(role, str) else role
    if not typed:
        return F.struct(role_c.alias("role"), content.cast("string").alias("content"))
    parts = F.array(text_part(content))
    if images is not None:
        parts = F.concat(F.transform(F.coalesce(images, F.array().cast("array<string>")), image_part), parts)
    return F.struct(role_c.alias("role"), parts.alias("content"))


def _empty(typed: bool) -> Column:
    return F.array().cast(f"array<{PART_MSG_TYPE if typed else TEXT_MSG_TYPE}>")


def system_message(text: Column | str, typed: bool = True, role: str = "system") -> Column:
    """System turn; an empty or null text gives no message (D1).  ``role='user'``
    emits the system text as a user turn (D2)."""
    t = _col(text)
    return F.when(_truthy(t), F.array(message(role, t, typed))).otherwise(_empty(typed))


def system_as_user(text: Column | str, typed: bool = True) -> Column:
    return system_message(text, typed, role="user")  # D2


def user_message(text: Column | str, images: Column | str | None = None, typed: bool = True) -> Column:
    """User turn: image parts first, then the text part (D3).  The text form
    ignores images, like the text-only models."""
    imgs = _col(images) if images is not None and typed else None
    return F.array(message("user", _col(text), typed, imgs))


def few_shot_messages(few_shot: Column | str, typed: bool = True) -> Column:
    """Each example -> user turn (with its images) + assistant turn, in order.

    ``few_shot`` is ``array<struct<ord, user, assistant, images>>``.
    """
    fs = _col(few_shot)
    pairs = F.transform(
        fs,
        lambda x: F.array(
            message("user", x["user"], typed, x["images"] if typed else None),
            message("assistant", x["assistant"], typed),
        ),
    )
    return F.coalesce(F.flatten(pairs), _empty(typed))


def conversation(system: Column | str | None, few_shot: Column | str | None, text: Column | str,
                 images: Column | str | None = None, typed: bool = True,
                 few_shot_msgs: Column | str | None = None) -> Column:
    """system ++ few-shot ++ user, each optional part skipped when empty.

    ``few_shot_msgs`` takes few-shot messages already built once per few-shot
    set (``operators.fewshot.with_messages``) instead of rebuilding them for
    every item row.
    """
    parts = []
    if system is not None:
        parts.append(system_message(system, typed))
    if few_shot_msgs is not None:
        parts.append(_col(few_shot_msgs))
    elif few_shot is not None:
        parts.append(few_shot_messages(few_shot, typed))
    parts.append(user_message(text, images, typed))
    return F.concat(*parts)


def split_system(messages: Column | str) -> tuple[Column, Column]:
    """(system text or null, the messages after a leading system turn)."""
    m = _col(messages)
    first = F.get(m, 0)
    has_sys = F.coalesce(first["role"] == F.lit("system"), F.lit(False))
    sys_text = F.when(has_sys, first["content"])
    rest = F.when(has_sys, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    return sys_text, rest


def fold_system_into_first_user(messages: Column | str) -> Column:
    """No system role: prefix ``system + "\\n\\n"`` to the first remaining turn
    (the first few-shot user turn, else the user turn) (D6).  Text form."""
    sys_text, rest = split_system(messages)
    return F.transform(
        rest,
        lambda m, i: F.when((i == 0) & _truthy(F.coalesce(sys_text, F.lit(""))),
                            F.struct(m["role"].alias("role"),
                                     F.concat(sys_text, F.lit(FOLD_SEPARATOR), m["content"]).alias("content")))
        .otherwise(m),
    )


def flat_prompt(system: Column | str | None, few_shot: Column | str | None, text: Column | str) -> Column:
    """Whole conversation as one text (D7): ``system\\n\\n``, then
    ``user\\nassistant\\n\\n`` per example, then the user text."""
    parts = []
    if system is not None:
        s = _col(system)
        parts.append(F.when(_truthy(s), F.concat(s, F.lit("\n\n"))).otherwise(F.lit("")))
    if few_shot is not None:
        fs = F.coalesce(_col(few_shot), F.array())
        parts.append(F.array_join(
            F.transform(fs, lambda x: F.concat(x["user"], F.lit("\n"), x["assistant"], F.lit("\n\n"))), ""))
    parts.append(_col(text))
    return F.concat(*parts)


# ---------------------------------------------------------------------------
# image placeholders
# ---------------------------------------------------------------------------

def placeholder_count(text: Column | str, token: str = IMAGE_TOKEN) -> Column:
    t = _col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(token), F.lit("")))) / F.lit(len(token))).cast("int")


def placeholder_error(text: Column | str, images: Column | str, token: str = IMAGE_TOKEN) -> Column:
    """More placeholders than images (D8); only checked when images is not null."""
    imgs = _col(images)
    return F.coalesce(imgs.isNotNull() & (placeholder_count(text, token) > F.size(imgs)), F.lit(False))


def placeholder_strip(text: Column | str, token: str = IMAGE_TOKEN) -> Column:
    return F.replace(_col(text), F.lit(token), F.lit(""))  # D9


def placeholder_fill(text: Column | str, images: Column | str, token: str = IMAGE_TOKEN) -> Column:
    """Images still to add as parts: the first ``size - count``.

    Null when images is null or when there are more placeholders than images
    (run ``placeholder_error`` first; the harness raised there)."""
    imgs = _col(images)
    n = placeholder_count(text, token)
    short = F.size(imgs) - n
    return F.when(imgs.isNull() | (short < 0), F.lit(None).cast("array<string>")).otherwise(F.slice(imgs, 1, short))


# ---------------------------------------------------------------------------
# chat formats (text form)
# ---------------------------------------------------------------------------

def role_alternation(messages: Column | str) -> Column:
    """After an optional leading system turn, roles alternate user/assistant
    starting with user (D11)."""
    _, rest = split_system(messages)
    return F.forall(F.transform(rest, lambda m, i: (m["role"] == F.lit("user")) == (i % 2 == 0)), lambda b: b)


def _fail_or_null(ok: Column, rendered: Column, strict: bool, msg: str) -> Column:
    if strict:
        return F.when(ok, rendered).otherwise(F.raise_error(F.lit(msg)).cast("string"))
    return F.when(ok, rendered)


def chat_chatml(messages: Column | str, add_generation_prompt: bool = True,
                default_system: str = CHATML["default_system"]) -> Column:
    """``<|im_start|>role\\ncontent<|im_end|>\\n`` per message; a default
    system turn when the first is not a system turn (D12)."""
    m = _col(messages)
    s, e = CHATML["start"], CHATML["end"]
    first_role = F.get(m, 0)["role"]
    prefix = F.when(first_role.isNotNull() & (first_role != F.lit("system")),
                    F.lit(f"{s}system\n{default_system}{e}\n")).otherwise(F.lit(""))
    body = F.array_join(F.transform(m, lambda x: F.concat(F.lit(s), x["role"], F.lit("\n"), x["content"], F.lit(f"{e}\n"))), "")
    cue = F.lit(f"{s}assistant\n" if add_generation_prompt else "")
    return F.concat(prefix, body, cue)


def chat_inst(messages: Column | str, bos: str = INST["bos"], eos: str = INST["eos"], strict: bool = False) -> Column:
    """``bos[INST] <<SYS>>..<</SYS>> user [/INST] assistant eos`` (D13): the
    system text is folded into the first turn, contents stripped, no cue."""
    sys_text, rest = split_system(messages)
    has_sys = sys_text.isNotNull()

    def one(x, i):
        content = F.when((i == 0) & has_sys,
                         F.concat(F.lit(INST["sys_open"]), sys_text, F.lit(INST["sys_close"]), x["content"])).otherwise(x["content"])
        return (F.when(x["role"] == "user", F.concat(F.lit(bos + INST["inst_open"]), strip_text(content), F.lit(INST["inst_close"])))
                .when(x["role"] == "assistant", F.concat(F.lit(" "), strip_text(content), F.lit(" " + eos)))
                .otherwise(F.lit("")))

    rendered = F.array_join(F.transform(rest, one), "")
    return _fail_or_null(role_alternation(messages), rendered, strict, "roles must alternate user/assistant")


def chat_header(messages: Column | str, date: str = HEADER["default_date"], add_generation_prompt: bool = True,
                bos: str = HEADER["bos"]) -> Column:
    """Header-id blocks with an end-of-turn token (D14).  A system block is
    always written: knowledge-date and today-date lines, then the trimmed
    system text (empty when there is none)."""
    sys_text, rest = split_system(messages)
    ho, hc, eot = HEADER["header_open"], HEADER["header_close"], HEADER["eot"]
    head = F.concat(
        F.lit(f"{bos}{ho}system{hc}{HEADER['knowledge_line']}{HEADER['date_prefix']}{date}\n\n"),
        F.coalesce(strip_text(sys_text), F.lit("")), F.lit(eot))
    body = F.array_join(F.transform(rest, lambda x: F.concat(F.lit(ho), x["role"], F.lit(hc), strip_text(x["content"]), F.lit(eot))), "")
    cue = F.lit(f"{ho}assistant{hc}" if add_generation_prompt else "")
    return F.concat(head, body, cue)


def chat_turn(messages: Column | str, add_generation_prompt: bool = True, bos: str = TURN["bos"],
              strict: bool = False) -> Column:
    """Turn-delimited format (D15): ``assistant`` is written as ``model``,
    contents trimmed, a system turn is rejected (fold it first with D6)."""
    m = _col(messages)
    st, en, model = TURN["start"], TURN["end"], TURN["assistant_role"]
    body = F.array_join(F.transform(m, lambda x: F.concat(
        F.lit(st), F.when(x["role"] == "assistant", F.lit(model)).otherwise(x["role"]), F.lit("\n"),
        strip_text(x["content"]), F.lit(en))), "")
    rendered = F.concat(F.lit(bos), body, F.lit(f"{st}{model}\n" if add_generation_prompt else ""))
    no_system = F.coalesce(F.get(m, 0)["role"] != F.lit("system"), F.lit(True))
    alternates = F.forall(F.transform(m, lambda x, i: (x["role"] == F.lit("user")) == (i % 2 == 0)), lambda b: b)
    return _fail_or_null(no_system & alternates, rendered, strict, "system role not supported / roles must alternate")


def chat_instruction_response(messages: Column | str, add_generation_prompt: bool = True,
                              bos: str = INSTRUCTION_RESPONSE["bos"], eos: str = INSTRUCTION_RESPONSE["eos"]) -> Column:
    """System text raw, instruction / response headed blocks, ``eos`` after each
    assistant turn, the response cue only after the last message (D16)."""
    m = _col(messages)
    uh, rh = INSTRUCTION_RESPONSE["user_header"], INSTRUCTION_RESPONSE["response_header"]
    n = F.size(m)

    def one(x, i):
        block = (F.when(x["role"] == "user", F.concat(F.lit(uh), x["content"]))
                 .when(x["role"] == "system", x["content"])
                 .when(x["role"] == "assistant", F.concat(F.lit(rh), x["content"], F.lit(eos)))
                 .otherwise(F.lit("")))
        if add_generation_prompt:
            block = F.concat(block, F.when(i == n - 1, F.lit(rh)).otherwise(F.lit("")))
        return block

    return F.concat(F.lit(bos), F.array_join(F.transform(m, one), ""))


def to_text_messages(messages: Column | str, role: str = "role", content: str = "text") -> Column:
    """``array<struct<..., role, text>>`` -> text-form messages."""
    return F.transform(_col(messages), lambda x: F.struct(x[role].alias("role"), x[content].alias("content")))
