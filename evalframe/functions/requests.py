"""Per-family request assembly: what each model wrapper family sends.

``prepare_request`` combines the conversation functions (D1-D10) and chat
formats (D12-D16) according to ``constants.MODEL_PROFILES``: vision families
get part-form messages with their placeholder handling, text families get
text-form messages plus the prompt rendered in their chat format, the flat
family gets one flat text.  Everything stays a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.constants import CHATML, MODEL_PROFILES
from evalframe.functions import chat as D


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def render_chat(messages: Column, chat_format: str, default_system: str | None = None) -> Column:
    if chat_format == "chatml":
        return D.chat_chatml(messages, default_system=default_system or CHATML["default_system"])
    if chat_format == "inst":
        return D.chat_inst(messages)
    if chat_format == "header":
        return D.chat_header(messages)
    if chat_format == "turn":
        return D.chat_turn(messages)
    if chat_format == "instruction_response":
        return D.chat_instruction_response(messages)
    raise ValueError(f"unknown chat format {chat_format}")


def _profile(family: str) -> tuple:
    if family not in MODEL_PROFILES:
        raise ValueError(f"no request profile for family {family!r}")
    return MODEL_PROFILES[family]


def part_form(family: str | None, typed: bool) -> bool:
    """Are a family's messages in part form (without one: as ``typed`` says)?"""
    if family is None:
        return typed
    vision, system_mode, *_ = _profile(family)
    return vision and system_mode != "flat"


def _sent(placeholder: str, vision: bool, text: Column, images: Column) -> tuple[Column, Column]:
    """The text and the images that are sent."""
    # placeholders are taken out only where images are sent
    user_text = F.when(images.isNotNull(), D.placeholder_strip(text)).otherwise(text) if placeholder == "strip" else text
    if placeholder == "fill":
        sent = F.coalesce(D.placeholder_fill(text, images), F.array().cast("array<string>"))
    elif vision:
        sent = F.coalesce(images, F.array().cast("array<string>"))
    else:
        sent = F.array().cast("array<string>")
    return user_text, sent


def around_few_shot(family: str | None, system: Column | str, text: Column | str, images: Column | str | None = None,
                    typed: bool = True) -> tuple[Column, Column] | None:
    """The messages before and after those of the few-shot examples; ``None``
    where the system text is folded into the first user turn, which may be an
    example's.  ``typed`` counts without a family only."""
    system, text, imgs = _col(system), _col(text), _col(images) if images is not None else F.lit(None).cast("array<string>")
    if family is None:
        return D.system_message(system, typed), D.user_message(text, images if typed else None, typed)
    vision, system_mode, placeholder, _, _ = _profile(family)
    if system_mode == "fold":
        return None
    parts, (user_text, sent) = part_form(family, typed), _sent(placeholder, vision, text, imgs)
    return (D.system_message(system, parts, "user" if system_mode == "user" else "system"),
            D.user_message(user_text, sent if parts else None, parts))


def prepare_request(family: str, system: Column | str, few_shot: Column | str, text: Column | str,
                    images: Column | str | None = None) -> dict[str, Column]:
    """Columns ``messages``, ``prompt_text``, ``request_images`` and
    ``placeholder_error`` for one model family.

    ``messages`` is part-form for vision families and text-form otherwise;
    ``prompt_text`` is the chat-format rendering (null where the model's own
    processor renders); ``request_images`` are the images actually sent.
    """
    vision, system_mode, placeholder, chat_format, default_system = _profile(family)
    system, few_shot, text = _col(system), _col(few_shot), _col(text)
    imgs = _col(images) if images is not None else F.lit(None).cast("array<string>")
    error = D.placeholder_error(text, imgs) if vision else F.lit(False)
    user_text, sent = _sent(placeholder, vision, text, imgs)
    around = around_few_shot(family, system, text, images)
    if around is None:
        messages = D.fold_system_into_first_user(D.conversation(system, few_shot, user_text, None, typed=False))
    else:
        messages = F.concat(around[0], D.few_shot_messages(few_shot, part_form(family, True)), around[1])
    if system_mode == "flat":
        prompt = D.flat_prompt(system, few_shot, user_text)
    elif vision:
        prompt = F.lit(None).cast("string")
    else:
        prompt = render_chat(messages, chat_format, default_system)
    return {"messages": messages, "prompt_text": prompt, "request_images": sent, "placeholder_error": error}
