"""Prompt templates as Column builders.

Templates are fixed text with ``{name}`` slots; ``render`` turns one into
a ``concat`` of literals and columns, so prompts are built JVM-side for
a whole table at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# =====================================================================
# FIXED VALUES (must equal the reference): prompt and rubric texts.
# =====================================================================

EXAMPLE_TEMPLATE = """
Historical Example {rank}

Customer:
{customer_text}

Spotify response:
{reply}

Similarity:
{similarity}
"""

GROUNDED_PROMPT = """
You are a professional Spotify customer support agent.

Your job is to analyze the customer message and produce:

1. A concise customer-facing support reply.
2. A decision:
   - AUTO-HANDLE
   - ESCALATE
3. A short reason for that decision.

CUSTOMER MESSAGE:
{customer_text}

PREDICTED INTENT:
{intent}

SIMILAR HISTORICAL SPOTIFY CONVERSATIONS:
{examples}

IMPORTANT RULES:

- Ground the response in the historical examples.
- Use the historical responses as guidance, not as text to copy.
- Respond directly to the customer's problem.
- Be polite, professional, and concise.
- Do not mention historical examples.
- Do not mention that you are an AI.
- Do not invent account information.
- Do not claim that you performed an action.
- Do not invent URLs.
- Do not include Twitter handles.
- Do not include internal agent initials.
- Do not copy historical responses word-for-word.
- If account-specific information is required, prefer ESCALATE.
- If the issue requires checking billing, account status,
  authentication, personal information, or another backend
  system that the support agent would need access to,
  prefer ESCALATE.
- Common troubleshooting questions that can be answered from
  the available historical support behavior can be AUTO-HANDLE.
- The reason must be specific to this customer's issue.
- Keep the customer-facing reply concise.

Return ONLY valid JSON in exactly this format:

{{
    "reply": "customer-facing response",
    "decision": "AUTO-HANDLE or ESCALATE",
    "reason": "short explanation"
}}
"""

REPLY_PROMPT = """
You are a professional Spotify customer-support agent.

Customer message:
{customer_text}

Write a concise customer-facing support response.

Rules:

1. Directly address the customer's issue.
2. Be polite and professional.
3. Give useful troubleshooting when appropriate.
4. Ask for device/app information when needed for technical issues.
5. For account, billing, payment, refund, login, or security issues,
   ask the customer to continue through DM and provide appropriate
   account-identifying information.
6. Never claim to have accessed an account.
7. Never claim to have performed a backend action.
8. Never invent URLs.
9. Do not mention that you are an AI.
10. Write only the customer-facing reply.
"""

RUBRIC = """
Evaluate the quality of a customer-support reply on a 1-5 scale.

5 = Excellent
- Directly addresses the customer's problem.
- Helpful and actionable.
- Appropriate Spotify support tone.
- Does not invent account information or actions.
- Does not make unsupported claims.
- Asks for additional information only when genuinely necessary.

4 = Good
- Correct and useful.
- Minor omissions or wording issues.
- Still appropriate for customer support.

3 = Acceptable
- Generally relevant.
- Somewhat generic or incomplete.
- Would probably require another support interaction.

2 = Poor
- Weakly addresses the problem.
- Missing important troubleshooting/support guidance.
- Too generic, confusing, or partially inappropriate.

1 = Unacceptable
- Irrelevant or incorrect.
- Unsafe.
- Invents actions/account information.
- Fails to address the customer's problem.

Return ONLY valid JSON:

{{
  "score": 1,
  "reason": "short explanation"
}}
"""

JUDGE_PROMPT = """
You are evaluating a Spotify customer-support agent.

CUSTOMER:
{customer_text}

AGENT REPLY:
{reply}

{rubric}
"""
# =====================================================================

_SLOT = re.compile(r"\{(\w+)\}|\{\{|\}\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a ``str.format`` template into ("lit", text) / ("slot", name)."""
    parts: list[tuple[str, str]] = []
    pos, buf = 0, ""
    for m in _SLOT.finditer(template):
        buf += template[pos:m.start()]
        if m.group(0) == "{{":
            buf += "{"
        elif m.group(0) == "}}":
            buf += "}"
        else:
            parts.append(("lit", buf))
            buf = ""
            parts.append(("slot", m.group(1)))
        pos = m.end()
    parts.append(("lit", buf + template[pos:]))
    return [p for p in parts if not (p[0] == "lit" and p[1] == "")]


def render(template: str, **slots: Column) -> Column:
    """``template.format(**slots)`` as one ``concat`` expression."""
    return F.concat(*[F.lit(v) if kind == "lit" else slots[v] for kind, v in template_parts(template)])


def fixed3(x: Column) -> Column:
    """Non-negative number as text with 3 decimals, via integer
    thousandths (same digits in every engine)."""
    v = F.round(x * 1000).cast("bigint")
    return F.concat((v.cast("long") / 1000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((v % 1000).cast("string"), 3, "0"))


def rubric_text() -> str:
    return RUBRIC.replace("{{", "{").replace("}}", "}")


def judge_prompt(customer_text: Column, reply: Column) -> Column:
    return render(JUDGE_PROMPT, customer_text=customer_text, reply=reply,
                  rubric=F.lit(rubric_text()))


def reply_prompt(customer_text: Column) -> Column:
    return render(REPLY_PROMPT, customer_text=customer_text)


def example_block(rank: Column, customer_text: Column, reply: Column, similarity: Column) -> Column:
    return render(EXAMPLE_TEMPLATE, rank=rank.cast("string"), customer_text=customer_text,
                  reply=reply, similarity=fixed3(similarity))


def grounded_prompt(customer_text: Column, intent: Column, examples: Column) -> Column:
    return render(GROUNDED_PROMPT, customer_text=customer_text, intent=intent, examples=examples)
