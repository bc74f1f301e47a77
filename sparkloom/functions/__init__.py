"""Column functions: messages, model calls, vectors, tokens and costs."""

from .accessor import ai
from .cost import cost_from_tokens, count_tokens, input_cost
from .inference import embedding, inference_async, inference_messages, tag_taxonomy
from .messages import combine_messages, conversation, string_to_message, template
from .vectors import cosine_similarity, dot_product, euclidean_distance

__all__ = [
    "ai", "combine_messages", "conversation", "cosine_similarity", "cost_from_tokens", "count_tokens", "dot_product", "embedding",
    "euclidean_distance", "inference_async", "inference_messages", "input_cost", "string_to_message", "tag_taxonomy", "template",
]
