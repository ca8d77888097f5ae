"""End-to-end flows: subset, augment, classify, profile, pilot."""
