"""Running counts over unbounded inputs; an extension of the batch operators."""
