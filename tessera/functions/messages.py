"""Texts of error codes in English and Chinese; results carry both."""

from __future__ import annotations

LANGUAGES = ("en", "zh")
TEXTS: dict[str, tuple[str, str]] = {
    "empty_query": ("The query has nothing to search for.", "查询没有可检索的内容。"),
    "range_only": ("A range filter needs a topic or a column filter beside it.", "范围过滤需要搭配主题词或列限定。"),
    "bad_query": ("The query's operators are misplaced.", "查询运算符的位置不正确。"),
    "bad_mode": ("Unknown search mode.", "未知的检索模式。"),
    "vector_unavailable": ("Vector search needs an embedder.", "向量检索需要嵌入模型。"),
    "vector_candidates_exceeded": ("The filter leaves too many entries for vector search.", "过滤后的条目超过向量检索上限。"),
    "empty_text": ("The text is empty.", "文本为空。"),
    "bad_workspace": ("The workspace name has characters that are not allowed.", "库名含有不允许的字符。"),
    "workspace_exists": ("The workspace exists already.", "该库已存在。"),
    "workspace_not_found": ("There is no such workspace.", "找不到该库。"),
    "no_workspaces": ("There is no workspace yet.", "还没有任何库。"),
    "confirm_needed": ("Deleting needs a confirmation.", "删除需要确认。"),
    "entry_not_found": ("There is no such entry.", "找不到该条目。"),
    "section_not_found": ("There is no such section.", "找不到该章节。"),
}


def error(code: str, detail: str = "", language: str = "en") -> dict:
    """An error result: code, text in one language, both texts, detail."""
    both = dict(zip(LANGUAGES, TEXTS.get(code, (code, code)), strict=True))
    return {"success": False, "code": code, "error": both[language], "error_i18n": both, "detail": detail}
