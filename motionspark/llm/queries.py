"""The registered queries of the corpus operators."""

from . import bpe, chat, infill, media, mixing, neardup, quality, ranked, secrets, substrings, tokens, topk, webtext

QUERIES = {
    "op1_substrings": substrings.op1_substrings,
    "op2_bpe": bpe.op2_bpe,
    "op3_topk": topk.op3_topk,
    "op4_secrets": secrets.op4_secrets,
    "op5_neardup": neardup.op5_neardup,
    "op6_chat": chat.op6_chat,
    "op7_mixing": mixing.op7_mixing,
    "op8_tokens": tokens.op8_tokens,
    "op9_media": media.op9_media,
    "op10_quality": quality.op10_quality,
    "op11_ranked": ranked.op11_ranked,
    "op12_webtext": webtext.op12_webtext,
    "op13_infill": infill.op13_infill,
}
ORACLE_SQL = {"op1_substrings": substrings.OP1_SQL, "op3_topk": topk.OP3_SQL, "op5_neardup": neardup.OP5_SQL, "op6_chat": chat.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op11_ranked": ranked.OP11_SQL, "op13_infill": infill.OP13_SQL}
