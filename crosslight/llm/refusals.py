"""Refusal phrases and placeholders, shared by the checks of answers."""

from __future__ import annotations

import re
from functools import lru_cache

from .automata import PhraseAutomaton

#: Phrases by which an answer declines its task, in lower case.
REFUSAL_PHRASES = (
    "无法为真实", "恕难从命", "不会参与信号控制", "超出我能提供", "选择不回答", "没有权限调整", "我就不给数字", "另找有资质", "作为语言模型", "作为一个语言模型", "作为人工智能", "无法提供帮助", "不能提供帮助", "无法协助", "不便回答", "拒绝回答", "无法回答这", "不能回答这", "请咨询当地主管部门", "可能带来安全风险",
    "unable to give a timing plan", "i must decline", "won't take part", "will not take part", "outside what i may help", "rather not answer", "no authority over", "leave the numbers to", "to a qualified office", "as a language model", "as an ai", "cannot help with th", "can't help with th", "cannot assist", "can't assist", "unable to help", "unable to assist", "not able to help", "not comfortable", "decline to", "the local authority can advise", "put people at risk",
)
#: Fixed value: what stands in place of an answer.
PLACEHOLDER = re.compile(r"(?i:[\s​﻿]*(?:\[\s*\]|\{\s*\}|null|none|nil|n/?a|tbd|todo|无|空|略|暂无|[（(](?:空|无|none|null|empty|blank)[)）]|```\w*\s*```|[\W_]*)[\s​﻿]*)*")
#: Reasoning about single phases; an answer that has it does the task, whatever else it says.
PHASE_WORK = re.compile(r"pred_saturation|相位\s*\d|\d\s*号相位|[Pp]hase \d|No\. \d+ reads|[Ff]ase \d|現示\s*\d|[Фф]аз\w* \d")


@lru_cache(maxsize=1)
def _automaton() -> PhraseAutomaton:
    return PhraseAutomaton(REFUSAL_PHRASES)


def is_refusal(text: str) -> bool:
    """Whether a text declines the task: a refusal phrase outside of any work on phases."""
    return bool(_automaton().find(text.lower())) and not PHASE_WORK.search(text)
