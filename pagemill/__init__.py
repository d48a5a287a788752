"""Page analytics on Spark: conversion, extraction, link graphs, jobs, usage and events."""
