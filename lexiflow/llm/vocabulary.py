"""Pieces of a public tokenizer, read from its file."""

from __future__ import annotations

PIECES = "/opt/tokenizers/piece_bpe_32k.model"  # default place; another can be given
MARK = "▁"  # stands for the start of a word


def letter_pieces(path: str = PIECES) -> list[str]:
    """The distinct lower-case pieces made of letters, with or without the start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    wanted = {t for t in texts if (t.removeprefix(MARK) or "a").isalpha() and t == t.lower()}
    return sorted(wanted | {MARK})
