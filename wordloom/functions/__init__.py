"""Column functions: tokens, packing, weights and decayed scores."""

from .scores import confidence, decay, edge_score, pack, quantize, unpack, word_score
from .text import MODES, normalize, piece_tokens, pieces, token_lines, tokens

__all__ = ["MODES", "confidence", "decay", "edge_score", "normalize", "pack", "piece_tokens", "pieces", "quantize", "token_lines", "tokens", "unpack", "word_score"]
