from .columns import all_of, any_tag, epoch_of, event_tag, first_tag, hash60, number_of, result, true_or_false, verdict_name

__all__ = ["all_of", "any_tag", "epoch_of", "event_tag", "first_tag", "hash60", "number_of", "result", "true_or_false", "verdict_name"]
