"""The functions in fluent form: ``ai("question").inference(...)``."""

from __future__ import annotations

from pyspark.sql import Column

from . import cost, inference, messages, vectors
from .columns import to_col


class ai:
    """The library's functions as methods of a column, which is their first argument."""

    def __init__(self, column):
        self.column = to_col(column)

    def to_message(self, *, message_type: str = "user") -> Column:
        return messages.string_to_message(self.column, message_type=message_type)

    def combine(self, *others) -> Column:
        return messages.combine_messages(self.column, *others)

    def inference(self, **options) -> Column:
        return inference.inference(self.column, **options)

    def inference_async(self, **options) -> Column:
        return inference.inference_async(self.column, **options)

    def inference_messages(self, **options) -> Column:
        return inference.inference_messages(self.column, **options)

    def embedding(self, **options) -> Column:
        return inference.embedding(self.column, **options)

    def tag_taxonomy(self, taxonomy: dict, **options) -> Column:
        return inference.tag_taxonomy(self.column, taxonomy, **options)

    def cosine_similarity(self, other) -> Column:
        return vectors.cosine_similarity(self.column, other)

    def dot_product(self, other) -> Column:
        return vectors.dot_product(self.column, other)

    def euclidean_distance(self, other) -> Column:
        return vectors.euclidean_distance(self.column, other)

    def knn(self, corpus, k: int = 5) -> Column:
        from ..operators.knn import knn_positions

        return knn_positions(self.column, corpus, k=k)

    def count_tokens(self, **options) -> Column:
        return cost.count_tokens(self.column, **options)

    def input_cost(self, **options) -> Column:
        return cost.input_cost(self.column, **options)

    def cost_from_tokens(self, **options) -> Column:
        return cost.cost_from_tokens(self.column, **options)
