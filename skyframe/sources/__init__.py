"""Readers and writers of image and catalogue files. Spark's binaryFile source lists and reads the files, on any file
system that it knows; the codecs below turn bytes into arrays and back."""
