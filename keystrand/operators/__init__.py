"""Part of Keystrand; see the README."""
