"""Readers, writers and the derivations that turn raw tables into listings."""
