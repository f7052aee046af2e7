"""End-to-end flows: corpus building, training and evaluation, scoring."""
